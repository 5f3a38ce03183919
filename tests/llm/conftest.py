import random

import pytest

#: Nulls, blanks, ties, repeats, long texts and copies with small edits.
VOCABULARY = [f"w{i}" for i in range(200)]


def corpus(seed: int = 7) -> list[str | None]:
    rng = random.Random(seed)
    shared = rng.choices(VOCABULARY, k=70)
    out: list[str | None] = [None, "", " \t\n", "a b", "A B", "a b c d e", "q " * 300, "é" * 500, "x" * 1500]
    for _ in range(12):
        base = rng.choices(VOCABULARY, k=rng.randint(6, 150))
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            out.append(" ".join(w + (shared if rng.random() < 0.3 else [])))
    out += ["\n".join(" ".join(rng.choices(VOCABULARY, k=8)) for _ in range(3)) + " " + " ".join(shared) for _ in range(6)]
    out.append(" ".join(rng.choices(VOCABULARY, k=9000)))
    return out


@pytest.fixture(scope="session")
def texts() -> list[str | None]:
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts, tmp_path_factory):
    """The corpus with columns whose names the operators use themselves."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    rows = [(i, t, ("en", None)[i % 2], (None, "s1", "s2", "s3")[i % 4], len(t or ""), i, i, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, class long, row_key string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
