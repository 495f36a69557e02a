"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing extra columns."""

import random

from pyspark.sql import Row

R = random.Random(3)
WORDS = ["alpha", "beta", "Gamma", "delta", "épée", "zürich", "of", "the", "and", "漢字", "x1", "row"]


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else R
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def documents(spark, texts, extra=True):
    rows = [Row(doc_id=i, text=t, lang=None if i % 3 == 0 else "en", source=f"src{i % 2}", n_chars=len(t or ""),
                **({"k": "clash", "b": 1.5, "id": "clash", "kept": True, "n_words": -1} if extra else {}))
            for i, t in enumerate(texts)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    kinds += ", k string, b double, id string, kept boolean, n_words int" if extra else ""
    return spark.createDataFrame(rows, kinds)


def texts():
    base = prose(120, 1)
    edited = base.split()
    edited[60] = "other"
    passage = prose(60, 2)
    return [
        None, "", " \n\t ", "one", "one two three", base, base, base.upper(), " ".join(edited),
        prose(40, 3) + " " + passage + " " + prose(30, 4), passage + " " + prose(50, 5), prose(25, 6) + "\n" + passage,
        "é" * 400 + prose(5, 7), "é" * 401, "aaaa " * 300, prose(3000, 8), "漢字 " * 90, "a,b;c" * 3,
        prose(12, 9), prose(13, 10),
    ]


def as_tables(docs, folder):
    """A folder with the documents table, as the registered queries read it."""
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)
