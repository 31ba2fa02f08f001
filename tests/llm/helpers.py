"""Rows that every operator has to take: nulls, empty and long texts, ties, repeated rows, clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, uid long, id long, key string, target double"


def words(i: int, n: int) -> str:
    return " ".join(f"w{(i * 7919 + j * j * 31 + j) % 5003}" for j in range(n))


def awkward(spark):
    rows = [(i, words(i, 20 + i % 50), "en", f"src{i % 3}") for i in range(40)]
    rows += [(100, words(1, 200), "en", "src1"), (101, words(1, 200), "de", None), (102, None, None, "src0"), (103, "", "en", "src0"), (104, " \t\n ", "en", "src2"), (105, "one", "en", "src2")]
    rows += [(106, words(9, 30_000), "en", "src0"), (107, "x" * 50_000, "en", "src0"), (None, "no id here at all", "en", "src1"), (5, words(5, 25), "en", "src2"), (5, words(5, 25), "en", "src2")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3, "k", 0.5) for r in rows], DOCS)


def none_of(df):
    return df.limit(0)
