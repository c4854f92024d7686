import random

import pytest

#: Names that operators use inside; a table may have them too.
CLASH = {"ref": 1, "key": "k", "n": 2, "kept": True, "digest": "d", "size": 5, "score": 0.5, "shard": 3, "rank": 1, "target": 2.0, "_score": 1.0, "_t": "x"}


def words(r, n, alphabet="abcdefghijklmnop"):
    return " ".join("".join(r.choices(alphabet, k=r.randint(2, 7))) for _ in range(n))


def make_docs(seed=1):
    """Texts of all kinds: empty, null, copies, near copies, one long, repeated rows."""
    r = random.Random(seed)
    texts = [words(r, r.randint(1, 120)) for _ in range(60)]
    long = words(r, 6000)
    base = words(r, 150).split()
    near = []
    for _ in range(6):
        copy = list(base)
        for _ in range(4):
            copy[r.randrange(len(copy))] = words(r, 1)
        near.append(" ".join(copy))
    hot = words(r, 40)
    all_ = [*texts, *texts[:5], None, "", None, "   ", "é ü\tñ\n", long, long + " end", " ".join(base), *near, *[hot] * 40]
    rows = [(i, t, r.choice("ab") + str(i % 3) if i % 11 else None) for i, t in enumerate(all_)]
    rows += [rows[3], rows[3], (None, "no name", "a0"), (None, texts[0], None)]
    return [(i, t, s, *CLASH.values()) for i, t, s in rows]


SCHEMA = "doc_id long, text string, source string, " + ", ".join(
    f"{k} {'int' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'string'}" for k, v in CLASH.items()
)


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
