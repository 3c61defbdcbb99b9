"""A small table of awkward documents."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", key string, ids string, spans string, n_words string, row string, words string"


def awkward_texts() -> list[str | None]:
    rng = random.Random(5)
    letters = list("ab re st's don't  \n\t.,09éñß中🙂\x1c'")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    words = ["the", "of", "thing", "eau", "über", "x1", "(token)", "end."]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    return [None, "", " ", "\n\n", "one", "one", *texts, long, long, "Ünïcode " * 50, "a" * 3000]


def special_texts() -> list[str]:
    """The string of an added token alone, at both ends, inside words, cut, and nested."""
    end = "<|endoftext|>"
    return [
        end, f"a {end} b", f"{end} b", f"a {end}", f"a{end}b", f"don'{end}t", f"  {end}  {end}\n", end * 3,
        "<|endoftext|", "|endoftext|>", "<|<|endoftext|>|>", f"é{end}中", f"x  {end}'s", end.upper(), "<|endof", "text|>",
    ]


def two_letter_words(size: int) -> list[str]:
    """Two words of two letters that polynomial hashes modulo 2^64 take for one."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]


def documents(spark: SparkSession, texts=None, extra: bool = True, first: int = 0) -> DataFrame:
    texts = awkward_texts() if texts is None else texts
    rows = [
        (first + i, t, None if i % 7 == 3 else "en", None if i % 5 == 2 else "src0", None if t is None else len(t))
        + (("k", "i", "s", "n", "r", "w") if extra else ())
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA + (EXTRA if extra else ""))


def with_tables(spark: SparkSession, folder, **tables: DataFrame) -> str:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
