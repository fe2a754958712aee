"""Small texts with copies, near copies, odd ones and rows that operators must survive."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, shard int, bucket int, score string, part string"

WORDS = {
    "en": "the of and to in is that it was for on are with as at be this have from or had by".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
}


def sentence(r: random.Random, lang: str, n: int) -> str:
    return " ".join(r.choice(WORDS[lang]) + (r.choice(["er", "ing", "ment", "ung", ""]) if r.random() < 0.5 else "") + (r.choice([".", ",", ""]) if r.random() < 0.2 else "") for _ in range(n))


def corpus(n: int = 120, seed: int = 1) -> list[tuple]:
    """Rows of SCHEMA: prose in three languages, exact and near copies, repeats, junk, empty and null values, one long text."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        rows.append([i, sentence(r, lang, r.randint(30, 200)), lang, f"src{r.choice([0, 0, 0, 1, 2, 3])}"])
    for i in range(n, n + 20):  # near copies of the first texts, chained
        words = rows[(i - n) // 4][1].split() if (i - n) % 4 == 0 else rows[i - 1][1].split()
        words[r.randrange(len(words))] = "changed"
        rows.append([i, " ".join(words), rows[(i - n) // 4][2], "src1"])
    rows += [[n + 20 + k, rows[3][1].upper() if k % 2 else rows[3][1], "en", "src0"] for k in range(8)]
    rows += [
        [n + 40, "", "en", "src1"], [n + 41, None, None, None], [n + 42, " \n\t ", "de", "src2"], [n + 43, "one", "en", "src2"], [n + 44, "one", "en", "src2"],
        [n + 45, "### $$$ 123 %%%", "en", "x"], [n + 46, "line one of this\nline one of this\n\nother\nline one of this", "en", "x"],
        [n + 47, sentence(r, "en", 9000), "en", "src0"], [n + 48, "und so weiter " * 300, "de", "src0"], [None, "no id here at all", "en", "src0"], [None, None, None, None],
        [7, rows[7][1], rows[7][2], "src0"], [n + 49, "日本語のテキスト Ünïcode ß", "de", "src3"], [n + 50, "<|endoftext|> x <|startoftext|>", "en", "src0"],
    ]
    return [tuple(x) + (9, 9, "s", "p") for x in rows]
