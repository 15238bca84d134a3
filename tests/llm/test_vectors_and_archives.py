"""Embeddings and archives against brute force, and the registry."""

import base64
import gzip
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from quern.llm import embeddings, warc
from quern.llm.queries import ORACLE_SQL, QUERIES


def test_bounds_are_rigorous():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(300, 24))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embeddings.quantise(u)
    about = (q @ q.T).astype(float) * s[:, None] * s[None]
    assert (np.abs(about - u @ u.T) <= e[:, None] + (1 + e[:, None]) * e[None] + embeddings.SLACK).all() and np.abs(q).max() <= 127


def test_tiles_recompute_only_unsure_pairs():
    draw, counts = np.random.default_rng(2), []
    x = draw.normal(size=(400, 16))
    y = x[:200] + draw.normal(size=(200, 16)) * 0.15
    found = {(i, j) for a, b in embeddings.tile_links(x, y, False, 0.98, lambda *n: counts.append(n)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    c = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)
    assert found == set(zip(*(k.tolist() for k in np.nonzero(c >= 0.98)), strict=True)) and sum(u for _, u in counts) < 0.05 * c.size


@pytest.mark.parametrize("block", [4096, 40])
def test_links(spark, block):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(60, 8))
    rows = [(k, (base[k % 60] + draw.normal(size=8) * (0.02 if k % 3 else 0.3)).astype(np.float32).tolist(), k % 2) for k in range(150)]
    rows += [(200 + k, rows[0][1], 0) for k in range(5)] + [(200, rows[0][1], 0), (None, rows[0][1], 0), (300, rows[0][1], None), (301, None, 0), (302, [], 0), (303, [0.0] * 8, 0), (304, [1.0, None] + [0.0] * 6, 0), (305, [float("nan")] + [1.0] * 7, 0), (306, [float("inf")] + [1.0] * 7, 0), (307, rows[0][1][:4], 0)]
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, node string, n int")
    out = embeddings.links(df, block=block).toPandas()
    usable = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    near = np.zeros((len(rows), len(rows)), bool)
    for i in usable:
        for j in usable:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            near[i, j] = i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98 - 1e-12
    root = np.arange(len(rows))
    for _ in range(len(rows)):
        root = np.minimum(root, np.where(near, root[None], len(rows)).min(axis=1))
    ids = [i for i, *_ in rows]
    least = [min((ids[k] for k in np.flatnonzero(root == r) if ids[k] is not None), default=None) for r in root]
    show = lambda x: None if pd.isna(x) else int(x)
    want = sorted(((ids[k], int(near[k].sum()), least[k]) for k in range(len(rows))), key=str)
    assert sorted(((show(a), int(b), show(c)) for a, b, c in zip(out.vec_id, out.n_links, out.component_id, strict=True)), key=str) == want
    assert (out.kept == [show(a) == show(c) for a, c in zip(out.vec_id, out.component_id, strict=True)]).all()


def test_links_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.links(df).count() == 0


PAGES = [(1, "http://a/x y", "<p>one</p>"), (2, "http://b\r\nX: y", "<p>one</p>"), (3, None, None), (4, "http://c", ""), (5, "http://d", "é" * 50_000), (2, "http://b\r\nX: y", "<p>one</p>"), (None, "http://e", "<p>one</p>"), (6, "http://f", "\r\n\r\nWARC/1.0\r\n")]


def test_archives(spark, tmp_path):
    df = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, payload string, sha string")
    out = warc.round_trip(df, str(tmp_path / "w")).toPandas()
    assert len(out) == len(PAGES)
    text = {i: h for i, _, h in PAGES}
    for r in out.itertuples():
        i = None if pd.isna(r.page_id) else int(r.page_id)
        body = (text[i] or "").encode()
        largest = max(k for k, h in text.items() if k is not None and (h or "").encode() == body)
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.record_type, None if pd.isna(r.refers_to) else int(r.refers_to)) == (("response", None) if i == largest else ("revisit", largest))
        assert r.payload is None or bytes(r.payload) == body
    # The files are ordinary gzip with a member per record.
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    content = b"".join(gzip.decompress(p.read_bytes()) for p in files)
    assert content.count(b"WARC-Record-ID: ") == len(PAGES) and b"\r\nX: y" not in content.replace(b"\r\n\r\n", b"")
    high = warc.round_trip(df, str(tmp_path / "v"), least_bytes=100).toPandas()
    assert set(high.record_type) == {"response"}


def test_reader_refuses_damage():
    data = warc.record(1, "u", b"payload", warc.digest(b"payload"), True, None, "2024-01-01T00:00:00Z")
    assert warc.parse(data)["payload"] == b"payload"
    for bad in (data.replace(b"payload\r\n", b"paYload\r\n"), data[:-1], data + b"x", b"junk", data.replace(warc.digest(b"payload").encode(), warc.digest(b"other").encode())):
        with pytest.raises(ValueError):
            warc.parse(bad)
    packed = warc.member(data)
    assert list(warc.read_members(memoryview(packed + b"\0" + packed))) == [data, data]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_members(memoryview(packed[:-3])))
    with pytest.raises(zlib.error):
        list(warc.read_members(memoryview(packed[:30] + b"\xff" + packed[31:])))


def test_archives_of_nothing(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w")).count() == 0


def test_registry():
    import corpus_pipeline

    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, sf_dir, name):
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    df, expected = QUERIES[name](spark, sf_dir).toPandas(), connection.sql(ORACLE_SQL[name]).df()
    columns = sorted(df.columns)
    # Whole numbers with nulls have another type in each engine's frames.
    pd.testing.assert_frame_equal(df[columns].sort_values(columns).reset_index(drop=True), expected[columns].sort_values(columns).reset_index(drop=True), check_dtype=False)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == documents.columns
        docs = out
    pieces = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 1024 and len(pieces) > 50
