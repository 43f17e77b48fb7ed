import os
import re

import duckdb
import pytest

TABLES = "documents embeddings pages benchmark labels conversations".split()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.fixture
def folder(spark, tmp_path):
    """Write rows as the tables of a folder."""

    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
        return str(tmp_path)

    return write


@pytest.fixture(scope="session")
def near_brute():
    def words(text):
        return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))

    def shingles(text, n=5):
        w = words(text)
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    def answer(rows, percent=75):
        sets = {i: shingles(t) for i, t in rows}
        up = {i: i for i in sets}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        ids = sorted(sets)
        for k, i in enumerate(ids):
            for j in ids[:k]:
                a, b = sets[i], sets[j]
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    x, y = root(i), root(j)
                    up[max(x, y)] = min(x, y)
        return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)

    return answer
