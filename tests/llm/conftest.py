import random

import pytest

ALPHABET = "the of and in to is that für und der die le la que el los con ñandú être ça".split()


@pytest.fixture(scope="session")
def words():
    rng = random.Random(4)
    return [rng.choice(ALPHABET) + rng.choice(["", "an", "er", "ting", "ción", "lich"]) for _ in range(4000)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, repeats, ties and clashing columns."""
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "a"), (4, "a"), (None, "x y z w v u t s r q"), (None, None),
        (5, "one two three four five six seven eight nine ten"), (6, "one two three four five six seven eight nine ten"),
        (7, "word " * 3000), (8, "漢字🙂 \u0000 end"), (9, "$$$ ### !!!"),
    ]
    rows = [(i, t, "en" if t else None, None, 1.5, True, 9, 8, "row", "h") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, kept boolean, n_words long, sequence_id long, row string, h string")


@pytest.fixture
def folder(tmp_path):
    """Write tables as <folder>/<name>.parquet and give the folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
