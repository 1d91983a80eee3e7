import pytest

LONG = "lange wörter und the words again " * 4000
TEXTS = [
    None, "", " \n\t ", "one", "two words", "The quick brown fox jumps over the lazy dog.\nThe quick brown fox jumps over the lazy dog.\n" * 3,
    "The quick brown fox jumps over the lazy dog.\nThe quick brown fox jumps over the lazy dog.\n" * 3,
    "Écoute, l'été arrive: il y a 12 345 oiseaux — et ½ pomme… 😀 中文字符 don't we'll <|endoftext|> x",
    "Mail a@b.co or x.y@d-e.org; call +49 (0)30 1234-5678, card 4111 1111 1111 1111, host 10.0.0.1 or 256.1.1.1",
    "Licensed under the GNU General Public License version 3 or later, CC BY-SA 4.0 and the MIT License", LONG, "x" * 70_000, "### $$$ %%% " * 30,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, shard string, fp string, n_words string, lang_pred string, kept string, _row string, x1 string, file string, _k long, _may string, _stays string, key string, stays string"


def rows():
    out = [(k, t, "en" if k % 3 else None, f"s{k % 2}" if k % 4 else None) for k, t in enumerate(TEXTS)]
    out += [out[5], out[5], (None, "a row without an id", "en", "s0"), (None, None, None, None)]
    return [(i, t, lang, source, len(t or ""), *["clash"] * 10, i, *["clash"] * 4) for i, t, lang, source in out]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
