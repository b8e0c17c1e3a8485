import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def docs(spark):
    """A few rows that hold the awkward cases: nulls, empty and long texts, repeats, more columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, media string, ids string, start long, digest string"
    rows = [
        (1, "Hello world, it's a test. We'll see; they've said so.", "en"),
        (2, None, None),
        (3, "", "en"),
        (4, "  two  spaces\tand\n\n lines \n", "en"),
        (4, "  two  spaces\tand\n\n lines \n", "en"),
        (None, "no id 123 x'sy 'll''re", "en"),
        (6, "x" * 70000 + " " + "long words " * 3000, "en"),
        (7, "Größe der Häuser, naïve 日本語 🙂🙂 　end", "de"),
    ]
    return spark.createDataFrame([(i, t, lang, "s", 0, "m", "i", 5, "d") for i, t, lang in rows], schema)


@pytest.fixture()
def folder(tmp_path, spark):
    """Write tables as `<name>.parquet` of a folder that queries can read."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
