from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None):
    """A documents table; texts may hold None."""
    sources = sources or ["a"] * len(texts)
    rows = [(i, t, "en", s, len(t) if t is not None else None) for i, (t, s) in enumerate(zip(texts, sources))]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, letters="bcdfgklmnprst"):
    return " ".join("".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))
