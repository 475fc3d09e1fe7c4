"""Small documents with the cases every operator must define."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, length long, rank long"

ODD = [
    None,
    "",
    " ",
    "\n \t",
    "a",
    "Don't stop... it's they'LL <|endoftext|> we've gone   x",
    "<|startoftext|>abc<|endoftext|>def <|ENDOFTEXT|> <|endoftext|>",
    "x" * 5000,
    "é è É K İstanbul ΣΑΣ ß\u0085\x1c\x1f tail  ",
    "12,345.67 $$$ !!! (a) 'tis 'S 's' don''t   　 end　",
    "  two  spaces \n\n\nnew lines \r\n tab\tend \x0b\x0c",
    "日本語 テキスト、です。 mixed ascii日本 №5 ½ x²",
    "́abc á́. .́ 'S.́ re'. it's. 're",
    "emoji 👩‍👩‍👧 🇩🇪!! ﻿​ zero",
    "a | b | c\n| d || e |\n",
]


def documents(spark, texts, sources=None, ids=None):
    """Documents with some extra columns whose names clash with inner ones."""
    sources = sources or ["s"] * len(texts)
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", s, None if t is None else len(t), 7, 7, 7) for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def words(n: int, seed: int = 0) -> str:
    """Prose of n words without chance repeats."""
    import random

    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(n))
