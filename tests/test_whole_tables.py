"""Queries over text of all scripts, against plain Python on non-ASCII rows."""

import re
import unicodedata

import pytest

from lexloom.plans.queries import QUERIES

TEXTS = ["Café – naïve — ﬁn x", "  ① thé état", None, "", "thе Über the, été", "plain the end", "WITH THAT said", "with thát", "日本 語、テ the語", "straße “so” thé", "a b c d e f g h é"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    spark.createDataFrame([(i, t, ["en", "fr", None][i % 3]) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(TEXTS)], "conv_id long, turn int, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at)


def nfkd(t):
    return unicodedata.normalize("NFKD", t or "").replace(" ", " ")


def ends(t):
    words = re.findall(r"\s*[\w\u0301]+|\s*[^\w\u0301\s]|\s+", t or "")
    return "".join(words if len(words) <= 3 else words[:3] + words[-3:])


@pytest.mark.parametrize(
    "name, column, want",
    [
        ("ascii_text", "folded", lambda t: nfkd(t).replace("–", "-").replace("—", "-").encode("ascii", "ignore").decode()),
        ("nfkd_length", "n", lambda t: len(nfkd(t).strip())),
        ("truncate_tokens", "text", ends),
        ("name_contains", "hit", lambda t: bool(re.search(r"\bthe(?![\w\u0301])", (t or "").lower())) or "with that" in (t or "").lower()),
    ],
)
def test_all_rows(spark, folder, name, column, want):
    got = {r[0]: r[column] for r in QUERIES[name](spark, folder).collect()}
    assert got == {i: want(t) for i, t in enumerate(TEXTS)}
