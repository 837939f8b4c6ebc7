import random

import numpy as np
import pytest

from brightwell.llm import shards, token_counts

SCHEMA = "doc_id bigint, text string"


def stream(rows, out):
    """Texts of the written shards, found at the end tokens, from the slots read back in sequence order."""
    n = len(rows)
    assert sorted(r.slot for r in rows) == sorted(r.sequence for r in rows) == list(range(n))
    slots = list(shards.read_slots(out, 0, n))
    order = shards.feistel(np.arange(n), n)
    end = shards.end_token(shards.vocabulary())
    size = {r.sequence: r.n_tokens for r in rows}
    assert all(r.slot == order[r.sequence] and r.byte_offset == r.slot % shards.SHARD * shards.LENGTH * 2 for r in rows)
    assert all((slots[r.slot][r.n_tokens :] == end).all() for r in rows)
    ids = np.concatenate([slots[order[i]][: size[i]] for i in range(n)])
    encoding = token_counts.spans(shards.vocabulary()).encoding
    return [encoding.decode(p[:-1].tolist()) for p in np.split(ids, np.flatnonzero(ids == end) + 1) if len(p)]


@pytest.mark.parametrize("parts", [1, 3])
def test_odd_rows(spark, tmp_path, parts):
    rows = [(1, None), (2, ""), (3, "x" * 50_000 + " y\n" * 300), (4, "été <|endoftext|> 日本"), (4, "été <|endoftext|> 日本"), (None, "no id"), (5, "été <|endoftext|> 日本")]
    out = f"file://{tmp_path}/s"
    found = shards.write_shards(spark.createDataFrame([(*r, 9, "s") for r in rows], SCHEMA + ", shard int, block string").repartition(parts), out).collect()
    assert sorted(stream(found, out)) == sorted(t or "" for _, t in rows)
    assert {r.first_doc_id for r in found} | {r.last_doc_id for r in found} <= {1, 2, 3, 4, 5, None}


def test_empty_table(spark, tmp_path):
    assert shards.write_shards(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/s").collect() == []


def test_several_shards_and_repeated_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SHARD", 64)
    monkeypatch.setattr(shards, "PART_SHARDS", 2)
    rng = random.Random(10)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 40, 4000])))) for i in range(120)]
    rows += rows[:17] + rows[:3]
    out = f"file://{tmp_path}/s"
    found = shards.write_shards(spark.createDataFrame(rows, SCHEMA).repartition(5), out).collect()
    assert len({r.shard for r in found}) >= 3 and len(list(tmp_path.glob("s/shard-*.bin"))) == len({r.shard for r in found})
    assert sorted(stream(found, out)) == sorted(t for _, t in rows)


def test_first_and_last_documents(spark, tmp_path):
    rows = [(i, "word " * 300) for i in range(9)]
    out = f"file://{tmp_path}/s"
    found = {r.sequence: r for r in shards.write_shards(spark.createDataFrame(rows, SCHEMA).coalesce(1), out).collect()}
    each = len(token_counts.spans(shards.vocabulary()).encoding.encode_ordinary(rows[0][1])) + 1
    for i, r in found.items():
        assert (r.first_doc_id, r.last_doc_id) == (i * shards.LENGTH // each, (i * shards.LENGTH + r.n_tokens - 1) // each)


def test_ids_that_do_not_fit(monkeypatch):
    class Large:
        size = np.zeros(70_000)

    monkeypatch.setattr(shards.token_counts, "spans", lambda path: Large)
    with pytest.raises(ValueError):
        shards.end_token("any")
