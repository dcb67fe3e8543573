"""Awkward documents for all operators: NULLs, empty and long texts, ties, repeated rows, columns with clashing names."""

import random
import re

import xxhash

WORDS = [a + b for a in ("ba", "do", "ki", "lu", "mé", "na", "pó", "ri") for b in ("ta", "ßen", "mo", "ri", "ñu", "xe", "la", "tion")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, k long, tag long, root long, score double, part int"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join(words[:60] + ["anders"] + words[61:])
    shared = prose(2, 70)
    rows = [
        (10, base), (11, base), (12, near), (13, base.upper()), (14, None), (15, ""), (16, "   \n\t "), (17, "!!! 123 --- 456"),
        (18, prose(3, 40) + "\n" + shared + "\n" + prose(4, 40)), (19, prose(5, 30) + " " + shared), (20, shared + " " + prose(6, 35)),
        (21, "ab" * 700), (22, prose(7, 20000)), (23, "x"), (24, "one two three"), (25, "one two three four five"), (26, "日本語 テキスト 😀 " * 30),
        (27, "a  b   c d \r\n e▁f <s> <|endoftext|> \x00\x1f"), (28, "zzz " * 400), (29, "zzz " * 401), (None, prose(8, 50)), (None, None), (30, prose(9, 300)), (-5, prose(10, 90)),
    ]
    return rows + [(10, base), (30, prose(9, 300))]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, 1, 2, 3, 4, 0.5, 6) for i, t in rows], SCHEMA).repartition(3)


def find(parent: dict, x):
    while parent[x] != x:
        x = parent[x]
    return x


def plain_fingerprint(text: str | None, width: int = 4) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[k:k + width]) for k in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
