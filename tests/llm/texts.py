"""Small documents that hold the awkward cases."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _q string, size long, kept string, digest string, verdict string"


def awkward() -> list[tuple]:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [
        None, "", "   \n\t ", "one", "a b c d", "x " * 40, "The same LINE\nThe same LINE\n\nother line here", prose(30), prose(400),
        "Ünï cödé ÀÉ words \u3000 wide", "tail space ", " lead", "a  b   c", "line\r\nline\r\n", "$$$ ### %%% &&& ||| <<<>>> a b c d e f g h i j k l m n o p q r s t",
        prose(25) + "\n" + prose(25), "<|endoftext|> text <s> </s>", "▁odd ▁marks", "\x00nul byte and more words", "emoji 😀 text 😀😀", prose(5000), "y" * 5000,
    ]
    again = prose(12)
    texts += [again + " " + prose(3) + " " + again + " " + prose(4), prose(50), prose(50)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", "s0", "s1", None][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "no id here", "en", "s0"), (500, rows[8][1], "en", "s1"), (501, rows[7][1], "en", "s0")]
    return [(i, t, g, s, len(t or ""), "c", 1, "c", "c", "c") for i, t, g, s in rows]
