"""Every operator that keeps extra columns, with every name that its code uses."""

import re
from pathlib import Path

import pytest

import drumlin.llm
from drumlin.llm import decontaminate, linededup, mixing, quality, secrets, sharding, simhash

TEXT = "the cat and the dog went to the house of a friend in the town, token=abcdef1, and it was good for them to be with the others that day"
NAMES = sorted(
    {n for f in Path(drumlin.llm.__file__).parent.glob("*.py") for n in re.findall(r'"(_{0,2}[a-z][a-z0-9_]{0,30})"', f.read_text())} - {"doc_id", "text", "lang", "source", "n_chars", "page_id", "html", "turn", "conv_id"}
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{TEXT} {'x' * i}", "en", f"s{i % 2}", *([i] * len(NAMES))) for i in range(4)]
    return spark.createDataFrame([*rows, rows[0]], ["doc_id", "text", "lang", "source", *NAMES])


KEEPERS = {
    "quality": quality.quality_filter, "simhash": simhash.drop_near_duplicates, "mixing": mixing.sample_to_targets, "redact": secrets.redact, "lines": linededup.drop_repeated_lines,
    "benchmark": lambda d: decontaminate.drop_contaminated(d, d.sparkSession.createDataFrame([("q7", "what is the name of this very small thing")], "item_id string, text string")),
}


@pytest.mark.parametrize("name", KEEPERS)
def test_extra_columns_stay(docs, name):
    assert len(NAMES) > 100
    out = KEEPERS[name](docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == r.doc_id for r in rows for c in NAMES)


def test_shards_keep_extra_columns(docs):
    out = sharding.shard_documents(docs)
    kept = [c for c in docs.columns if c not in (*sharding.ADDED, "text")]
    assert out.columns == [*kept, *sharding.ADDED]
    assert all(r[c] == r.doc_id for r in out.collect() for c in kept if c in NAMES)


def test_reports_ignore_extra_columns(docs):
    for report in (simhash.simhash_components, secrets.scan_secrets, linededup.line_dedup_report, mixing.mixing_report):
        assert report(docs).count() == 5
    counted = quality.quality_rules(docs)
    assert set(quality.ADDED) <= set(counted.columns) and {r.n_words for r in counted.collect()} == {29, 30}


def test_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([("d1", f"so {TEXT} it is"), ("d2", "nothing of the kind stands in here")], "doc_id string, text string")
    items = spark.createDataFrame([("item-a", TEXT), ("item-b", None), (None, "words that nobody else would ever use in a text")], "item_id string, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_contamination(docs, items).collect()] == [("d1", "item-a", 0)]
