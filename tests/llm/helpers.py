"""Odd inputs that every text operator must take, and plain word rules."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = " ".join(f"word{i % 700} the" for i in range(30_000))
ODD_TEXTS = (None, "", " \n\t\x0b ", "one", "two words", "a b c", "a b c", "İĞ ÑÇ naïve x y", "x" * 50_000, LONG, "tie tie tie tie tie tie", "tie tie tie tie tie tie", "é́ combining 𝔘nicode 😀")


def odd_documents(spark):
    """Nulls in every column, repeated rows and ids, long texts, and columns that clash with the operators' own."""
    rows = [(i if i != 3 else None, t, "en", None if i % 4 == 0 else "src0", 1, 7, "k", 0.5, 1) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], rows[9]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, kept string, score double, fp int")


def no_documents(spark):
    return odd_documents(spark).limit(0)


def words(text):
    return WORD.findall(text or "")
