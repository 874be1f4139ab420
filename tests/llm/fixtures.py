"""Small documents with what real tables have: nulls, empty texts, ties, repeated rows, copies, long texts, other columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, words int"


def documents(spark, n: int = 60):
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "harbour", "stone", "river", "été", "größe", "mañana", "light", "paper", "A-1", "x", "Straße"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary) + ("\n" if rng.random() < 0.1 else "") for _ in range(rng.choice([3, 12, 40, 200])))
        rows.append((i, text, "en", f"src{i % 3}", len(text), 0.5, 1))
    long = " ".join(rng.choice(vocabulary) for _ in range(9000))
    rows += [
        (100, None, "en", "src0", None, None, None), (101, "", None, None, 0, 0.0, 0), (102, "  \n\t ", "fr", "src0", 5, 0.0, 0),
        (103, long, "en", "src0", len(long), 0.0, 0), (104, long + " end", "en", "src1", 0, 0.0, 0), (105, rows[3][1], "en", "src0", 0, 0.0, 0),
        (106, "tab\tand\x0bvertical\x0cform  double   triple \n line", "en", "src0", 0, 0.0, 0), (107, "数据 处理 🙂 😀😀 é   nbsp <|endoftext|>", "zh", "src2", 0, 0.0, 0),
        (108, "go go go go go go go go go go go go go go go", "en", "src2", 0, 0.0, 0), (109, "### ### ### a b c d e f g h i j k l", "en", "src2", 0, 0.0, 0),
        (None, "a row without an id", "en", "src0", 0, 0.0, 0), (None, None, None, None, None, None, None), rows[5], rows[5],
    ]
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, tmp_path, name, df):
    df.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
