"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns, and brute-force versions."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PLAIN = " ".join(f"alpha{i} beta{i % 7} gamma" for i in range(60))


def rows() -> list[tuple]:
    """doc_id, text, lang, source, n_chars, and columns named like those that operators add."""
    near = PLAIN.replace("alpha30", "other")
    texts = [
        (1, PLAIN, "en", "src0"), (2, PLAIN, "en", "src0"), (3, near, "en", "src1"), (4, None, "en", "src0"), (5, "", None, None),
        (6, " \t\n\x0b ", "xx", "unlisted"), (7, "one", "de", "src1"), (8, "ONE", "de", "src1"), (9, "one two", "fr", "src2"),
        (10, LONG, "es", "src0"), (11, LONG + " end", "es", "src0"), (12, "Grüße ünïcode 漢字 🙂 " * 30, None, "src3"),
        (1, PLAIN, "en", "src0"), (None, PLAIN, "en", "src0"), (13, "a\na\n\nb\na\n " * 20, "en", "src0"), (14, "the of and " * 40, "en", "src2"),
        (15, "x" * 100_000, "en", "src0"), (16, "1" * 50_000, "en", "src0"), (17, "%%% ### $$$ " * 50, "en", "src1"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), 1, "z", 2.5, "k") for i, t, lang, s in texts]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, kept string, n_words double, slot string"


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text: str | None, width: int) -> frozenset:
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(docs: list[tuple], width: int, num: int, den: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [(i, shingle_set(t, width)) for i, t in docs]
    able = [k for k, (i, s) in enumerate(sets) if i is not None and s]
    up = list(range(len(sets)))

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for p, a in enumerate(able):
        for b in able[:p]:
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if den * both >= num * (len(x) + len(y) - both):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(s), least[top(k)] if i is not None else None) for k, (i, s) in enumerate(sets)), key=str)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def table_of(spark, data: list[tuple], schema: str):
    return spark.createDataFrame(data, schema)
