"""Small documents with all the odd cases."""

import random

_R = random.Random(3)
VOCABULARY = ["".join(_R.choice("abcdefgäéß") for _ in range(_R.randint(2, 7))) for _ in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", ".", ",", ".\n"]) for _ in range(n))


BASE = prose(1, 300)
PASSAGE = prose(2, 40)
ROWS = [
    (1, BASE),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, BASE),
    (6, BASE.replace(VOCABULARY[5], "changed", 1)),
    (7, prose(7, 120) + "\n" + PASSAGE + "\n" + prose(8, 90)),
    (8, prose(9, 60) + " " + PASSAGE.upper()),
    (9, prose(10, 30_000)),
    (10, "One"),
    (11, "one  two\tthree\n"),
    (12, "one two three"),
    (13, "same words " * 200),
    (14, ("A line of text that comes back often.\n" * 30) + "end"),
    (15, "ÉCOLE " * 30 + "<|endoftext|> x <|endoftext|>"),
    (16, "line sep nbsp \x1c unit \x85 next"),
    (17, "### $$$ %%% word### other$$$ | bar | bar"),
    (None, "no id here at all, five or more words"),
    (20, prose(20, 200)),
    (20, prose(20, 200)),
    (21, prose(21, 200) + " 4539578763621486 2024-02-30 2023-05-01 a.b@c.example.com"),
]
ITEMS = [(1, PASSAGE, 1), (2, "one two three", 1), (3, None, 1), (4, "", 1), (4, prose(9, 60), 1), (5, "never seen anywhere at all in these documents which is long", 1), (1, PASSAGE, 2)]
