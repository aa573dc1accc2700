"""Archives written and read back, records against what was written, captures against plain joins."""

import gzip
import hashlib

import pytest

from tickloom.llm import queries
from tickloom.llm.warc import assemble_captures, cut_records, page_records, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, value string, keep_id string"
BREAK = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"


def pages():
    big, other = "ä" * 600, "b" * 1000
    rows = [(i, f"http://x.example/{i}", big) for i in range(5)]
    rows += [(10, "http://y.example/\r\nX: y", other), (11, None, other), (12, "u", "short"), (13, "u", "short")]
    rows += [(14, "u", None), (15, "u", ""), (16, "u", BREAK * 40), (17, "u", BREAK + "x"), (18, "u", "c" * 300_000)]
    rows += [(None, "n", "d" * 2000), (30, "n", "d" * 2000), (None, "n", "e" * 2000), (None, "m", "e" * 2000)]
    return rows


def test_round_trip(spark, tmp_path):
    rows = pages()
    path = str(tmp_path / "a")
    write_warc(spark.createDataFrame([(*r, "v", "k") for r in rows], SCHEMA).repartition(3), path)
    records = read_warc(spark, path).collect()
    assert len(records) == 3 * len(rows)
    out = assemble_captures(read_warc(spark, path)).collect()
    pages_of = {r.response.record_id: r.metadata.payload.decode() for r in out}
    got = []
    for r in out:
        page = r.metadata.payload.decode().removeprefix("page-id: ").strip() or None
        refers = pages_of.get(r.response.refers_to)
        got.append(
            (page, r.response.type, refers and refers.removeprefix("page-id: ").strip(), r.response.payload_bytes,
             r.response.payload_digest, r.response.target_uri)
        )
        assert r.request.type == "request" and (r.n_requests, r.n_metadata) == (1, 1)
        if r.response.type == "response":
            assert hashlib.sha1(r.response.payload).hexdigest() == r.response.payload_digest
    want = []
    for i, url, html in rows:
        data = (html or "").encode()
        same = [x for x, _, h in rows if (h or "") == (html or "") and x is not None]
        last = max(same, default=None)
        again = len(data) >= 1000 and last is not None and last != i
        uri = url and url.replace("\r", "%0D").replace("\n", "%0A")
        want.append(
            (None if i is None else str(i), "revisit" if again else "response", str(last) if again else None,
             len(data), hashlib.sha1(data).hexdigest(), uri)
        )
    # Rows without an id and with equal payloads share record ids, so a join may pair them anyhow.
    named = [x for x in want if x[0] is not None]
    assert sorted(map(str, [x for x in got if x[0] is not None])) == sorted(map(str, named))


def test_files_follow_the_format(spark, tmp_path):
    path = tmp_path / "b"
    write_warc(spark.createDataFrame([(*r, "v", "k") for r in pages()], SCHEMA).coalesce(1), str(path))
    files = list(path.glob("part-*.gz"))
    data = gzip.decompress(files[0].read_bytes())
    assert len(files) == 1 and data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")
    for compressed in (data, gzip.compress(data[:5000]) + gzip.compress(data[5000:]), files[0].read_bytes()):
        assert len(list(cut_records(compressed, "f"))) == 3 * len(pages())


def test_broken_archives_are_errors():
    data = b"\r\n\r\n".join(page_records(1, "u", b"x" * 50, None, hashlib.sha1(b"x" * 50).digest())) + b"\r\n\r\n"
    assert len(list(cut_records(data, "f"))) == 3 and list(cut_records(b"", "f")) == []
    for bad in (data[:-30], b"nonsense" + data, data.replace(b"Content-Length: ", b"Content-Size: ")):
        with pytest.raises(ValueError):
            list(cut_records(bad, "f"))


def test_captures_by_either_direction(spark):
    schema = (
        "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
        "payload_digest string, payload_bytes long, http_status int, headers map<string,string>, payload binary"
    )

    def record(name, kind, to=()):
        return (name, kind, "u", "d", list(to), None, None, 0, None, {}, b"")

    rows = [
        record("r1", "response"), record("q1", "request", ["r1"]), record("m1", "metadata", ["r1"]),
        record("m2", "metadata", ["r1"]), record("r2", "response", ["q2"]), record("q2", "request"),
        record("r3", "revisit"), record("q9", "request", ["gone"]), record("w", "warcinfo"), record("q8", "request"),
    ]
    out = {r.capture_id: r for r in assemble_captures(spark.createDataFrame(rows, schema)).collect()}
    assert set(out) == {"r1", "r2", "r3", "gone"}
    assert out["r1"].request.record_id == "q1" and out["r1"].metadata.record_id == "m1"
    assert out["r1"].n_metadata == 2 and out["r2"].request.record_id == "q2" and out["r2"].metadata is None
    assert out["r3"].request is None and out["gone"].response is None and out["gone"].request.record_id == "q9"
    assert assemble_captures(spark.createDataFrame([], schema)).collect() == []


def test_empty_table(spark, tmp_path):
    write_warc(spark.createDataFrame([], SCHEMA), str(tmp_path / "c"))
    assert read_warc(spark, str(tmp_path / "c")).collect() == []


def test_archives_are_read_once(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://x/{i}", "p" * (1500 + i % 3)) for i in range(12)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    plans, cut = [], queries.cut_lineage

    def seen(df, *rest):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df, *rest)

    monkeypatch.setattr(queries, "cut_lineage", seen)
    out = queries.op3_warc(spark, str(tmp_path))
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert sum(plan.count("MapInArrow") for plan in plans) == 1
    assert {r.page_id: (r.record_type, r.refers_to) for r in out.collect()} == {
        i: ("response", None) if i > 8 else ("revisit", 9 + i % 3) for i in range(12)
    }
