"""The upstream source against a server that refuses, stumbles and pages."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from quillspark.sources import polling, upstream
from quillspark.sources.upstream import Upstream


ITEMS = '{"items": "items"}'


@pytest.fixture
def server():
    seen = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            seen[self.path] = tries = seen.get(self.path, 0) + 1
            start, at = int(q["since"]), int(q.get("cursor", 0))
            code = 404 if start == 200 and at == 2 else 503 if tries == 1 else 429 if tries == 2 else 200
            ids = [*range(start, int(q["until"]), 10)]
            own = ids[at : at + int(q["limit"])]
            body = json.dumps({"items": [{"id": f"e{i}", "type": "message"} for i in own] + [{"type": "none"}], "next_cursor": str(at + len(own)), "has_more": at + len(own) < len(ids)})
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    own = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}/log", seen
    own.shutdown()


def test_pages_retries_and_partial_failures(spark, server):
    address, seen = server
    spark.dataSource.register(Upstream)
    rows = spark.read.format("upstream").options(address=address, since=100, until=300, window=100, limit=2, overlap=20, pause=0.01, fields=ITEMS).load().collect()
    assert sorted(r.source_event_id for r in rows if r.source_event_id) == sorted(f"e{i}" for i in [*range(80, 200, 10), 200, 210])
    [failure] = [r for r in rows if r.error]
    assert (failure.window_start, failure.page) == (200, 1) and "404" in failure.error
    assert all(n == (1 if "since=200" in p and "cursor=2" in p else 3) for p, n in seen.items())


def test_attempts_are_bounded_and_pages_too(spark, server):
    address, seen = server
    spark.dataSource.register(Upstream)
    read = lambda **more: spark.read.format("upstream").options(address=address, since=100, until=200, window=100, limit=2, overlap=0, pause=0.01, fields=ITEMS, **more).load().collect()
    assert [r.error.partition(":")[0] for r in read(attempts=2)] == ["ConnectionError"] and set(seen.values()) == {2}
    capped = read(pages=2)
    [left] = [r for r in capped if r.error]
    assert (len(capped), left.error, left.page, left.window_start, left.window_end, left.cursor) == (5, "page_cap", 2, 100, 200, "4")
    rest = read(lanes=json.dumps([[left.window_start, left.window_end, left.cursor, left.page]]))
    assert sorted(r.source_event_id for r in capped + rest if r.source_event_id) == sorted(f"e{i}" for i in range(100, 200, 10)) and not any(r.error for r in rest)


def test_waits_double_up_to_their_bound(monkeypatch):
    waits = []
    monkeypatch.setattr(upstream.time, "sleep", waits.append)

    def fails(url):
        raise OSError

    with pytest.raises(ConnectionError):
        upstream.retried("x", fails, attempts=8)
    assert len(waits) == 7 and all(0.5 * min(2**k, 30) <= w <= 1.5 * min(2**k, 30) for k, w in enumerate(waits))


def test_items_by_dotted_paths():
    fields = upstream.fields_of({"fields": '{"id": "meta.key", "deleted": "flags.gone", "nonsense": "x"}'})
    row = upstream.event({"meta": {"key": 7}, "flags": {"gone": 0}, "type": "File.Deleted", "created_at": 1700000000000, "user": {"email": "a@b"}, "workspace_id": 3}, fields)
    assert row[:8] == ("7", "File.Deleted", "2023-11-14T22:13:20+00:00", None, None, "3", "a@b", True)
    assert upstream.event({"meta": {"key": "x"}, "flags": {"gone": 1}, "created_at": "2024-05-01T12:00:00+02:00"}, fields)[:8] == ("x", "unknown", "2024-05-01T10:00:00+00:00", None, None, None, None, True)
    assert upstream.event({"meta": 5}, fields) is None and upstream.event([], fields) is None
    assert upstream.fields_of({"fields": "{"}) == upstream.fields_of({"fields": "[]"}) == upstream.FIELDS
    assert [upstream.iso_time(x) for x in (True, None, "soon", 1e300, "2024-01-01")] == [None, None, "soon", None, "2024-01-01T00:00:00+00:00"]


def test_kinds_by_ordered_rules(spark):
    cases = {"Message.Deleted": "deletion", "purged": "deletion", "chat.message": "message", "CHAT": "conversation", "conversation.x": "conversation", "file.y": "file", "attachment": "file", "login": "unknown", "": "unknown"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.k for r in df.select("t", polling.kind_of(df.t).alias("k")).collect()} == cases


class Pages:
    """An upstream in a folder: windows of 100 seconds with an event every 5, in pages of 3; one page is missing until it is put there."""

    def __init__(self, folder, until=300):
        self.folder, self.ids = folder, {}
        folder.mkdir()
        for start in range(0, until, 100):
            self.window(start, start + 100)

    def window(self, start, end):
        ids = [f"e{i}" for i in range(start, end, 5)]
        for k in range(0, len(ids), 3):
            page = {"data": [{"id": i, "type": "message", "created_at": int(i[1:])} for i in ids[k : k + 3]], "next_cursor": f"k{k + 3}", "has_more": k + 3 < len(ids)}
            (self.folder / f"{start}-{f'k{k}' if k else ''}.json").write_text(json.dumps(page))

    def options(self, state, **more):
        return {"address": f"file://{self.folder}/{{since}}-{{cursor}}.json", "since": "0", "until": "300", "window": "100", "overlap": "0", "pages": "2", "attempts": "1", "state": f"file://{state}"} | more


def cycle(reader, start):
    """What Spark asks of a source in a micro-batch."""
    end = reader.latestOffset()
    return end, [row for p in reader.partitions(start, end) for row in reader.read(p)]


def test_a_cap_ends_a_cycle_and_not_the_window(tmp_path):
    reader = polling.UpstreamStream(Pages(tmp_path / "up").options(tmp_path / "state"))
    start, seen, sizes = reader.initialOffset(), [], []
    for k in range(1, 9):
        end, rows = cycle(reader, start)
        sizes.append(len(rows))
        seen += [r[0] for r in rows]
        if end == start:
            break
        assert end == {"cycle": k}
        start = end
    assert sizes == [18, 18, 18, 6, 0] and sorted(seen) == sorted(f"e{i}" for i in range(0, 300, 5))
    assert polling.UpstreamStream(reader.options).latestOffset() == start  # another driver, nothing new
    again = polling.UpstreamStream(reader.options)
    assert sorted(r[0] for p in again.partitions({"cycle": 0}, start) for r in again.read(p)) == sorted(seen)  # from the beginning, without the checkpoint


def test_a_cycle_that_is_read_again_ends_where_it_ended(tmp_path):
    pages = Pages(tmp_path / "up")
    options = pages.options(tmp_path / "state")
    reader = polling.UpstreamStream(options)
    end, first = cycle(reader, {"cycle": 0})
    following = reader.latestOffset()  # planned by the marks of the first cycle, though its batch isn't committed
    assert following == {"cycle": 2}
    wider = polling.UpstreamStream(options | {"pages": "5"})
    again = [row for p in wider.partitions({"cycle": 0}, end) for row in wider.read(p)]
    assert sorted(r[0] for r in again) == sorted(r[0] for r in first)
    _, rest = cycle(wider, end)
    assert not {r[0] for r in rest} & {r[0] for r in first}


def test_a_lost_task_is_read_again_before_the_next_plan(tmp_path):
    reader = polling.UpstreamStream(Pages(tmp_path / "up").options(tmp_path / "state"))
    end = reader.latestOffset()
    one, two, three = reader.partitions({"cycle": 0}, end)
    list(reader.read(one))
    next(iter(reader.read(two)))  # lost in the middle
    assert reader.latestOffset() == end
    assert len(list(reader.read(two))) == 6 and len(list(reader.read(three))) == 6
    assert reader.latestOffset() == {"cycle": 2}


def test_failures_are_counted_and_windows_go_on(spark, tmp_path):
    pages = Pages(tmp_path / "up")
    hidden = tmp_path / "up" / "100-k3.json"
    text = hidden.read_text()
    hidden.unlink()
    options = pages.options(tmp_path / "state", failures="3")
    reader = polling.UpstreamStream(options)
    start, seen = {"cycle": 0}, []
    for _ in range(2):
        start, rows = cycle(reader, start)
        seen += [r[0] for r in rows]
    state = {r.start: r for r in polling.cursors(spark, f"file://{tmp_path}/state").collect()}
    assert (state[100].failures, state[100].page, state[100].cursor, state[100].healthy) == (2, 1, "k3", True) and "ConnectionError" in state[100].left
    assert (state[0].failures, state[0].left, state[0].events, state[0].last_event_time.second) == (0, "page_cap", 12, 55)
    hidden.write_text(text)
    while True:
        end, rows = cycle(reader, start)
        seen += [r[0] for r in rows]
        if end == start:
            break
        start = end
    assert sorted(seen) == sorted(f"e{i}" for i in range(0, 300, 5))
    assert {(r.start, r.left, r.failures) for r in polling.cursors(spark, f"file://{tmp_path}/state").collect()} == {(0, None, 0), (100, None, 0), (200, None, 0)}


def test_a_window_that_keeps_failing_is_left_alone(tmp_path):
    pages = Pages(tmp_path / "up")
    (tmp_path / "up" / "100-.json").unlink()
    reader = polling.UpstreamStream(pages.options(tmp_path / "state", failures="2"))
    start, seen = {"cycle": 0}, []
    for _ in range(9):
        end, rows = cycle(reader, start)
        seen += [r[0] for r in rows]
        if end == start:
            break
        start = end
    assert start == {"cycle": 4} and len(seen) == 40


def test_new_windows_open_behind_the_last_and_reach_back(tmp_path):
    pages = Pages(tmp_path / "up", until=200)
    pages.window(180, 300)
    reader = polling.UpstreamStream(pages.options(tmp_path / "state", until="200", pages="9"))
    start, rows = cycle(reader, {"cycle": 0})
    later = polling.UpstreamStream(reader.options | {"until": "300", "overlap": "20"})
    _, more = cycle(later, start)
    assert len(rows) == 40 and sorted(r[0] for r in more) == sorted(f"e{i}" for i in range(180, 300, 5))


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    spark.dataSource.register(Upstream)
    pages = Pages(tmp_path / "up")
    options = pages.options(tmp_path / "state")

    def run(trigger):
        stream = spark.readStream.format("upstream").options(**options).load()
        q = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/rows").option("checkpointLocation", f"file://{tmp_path}/check").trigger(**trigger).start()
        q.awaitTermination() if "availableNow" in trigger else q.processAllAvailable()
        q.stop()
        return spark.read.parquet(f"file://{tmp_path}/rows").count()

    assert run({"availableNow": True}) == 18  # one cycle
    assert run({"processingTime": "0 seconds"}) == 60
    got = polling.admitted_events(spark.read.parquet(f"file://{tmp_path}/rows")).collect()
    assert len(got) == 60 and {r.kind for r in got} == {"message"}


def test_a_batch_pull_goes_on_behind_its_cap(spark, tmp_path):
    spark.dataSource.register(Upstream)
    pages = Pages(tmp_path / "up")
    options = {k: v for k, v in pages.options("").items() if k != "state"}
    rows = upstream.pulled(spark, f"file://{tmp_path}/rows", **options).collect()  # 7 pages a window, 2 a pull
    assert sorted(r.source_event_id for r in rows) == sorted(f"e{i}" for i in range(0, 300, 5)) and not any(r.error for r in rows)
    (pages.folder / "100-k9.json").unlink()
    rows = upstream.pulled(spark, f"file://{tmp_path}/again", **options).collect()
    assert [(r.window_start, r.page, r.cursor) for r in rows if r.error] == [(100, 3, "k9")]
    assert sorted(r.source_event_id for r in rows if not r.error) == sorted(f"e{i}" for i in [*range(0, 145, 5), *range(200, 300, 5)])


def test_a_backlog_takes_more_pages_in_each_cycle(tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    for k in range(40):
        (folder / f"0-{k or ''}.json").write_text(json.dumps({"data": [{"id": f"e{k}", "created_at": k}], "next_cursor": str(k + 1), "has_more": k < 39}))
    reader = polling.UpstreamStream({"address": f"file://{folder}/{{since}}-{{cursor}}.json", "since": "0", "until": "100", "window": "100", "overlap": "0", "pages": "2", "most_pages": "12", "attempts": "1", "state": f"file://{tmp_path}/state"})
    start, seen, sizes = reader.initialOffset(), [], []
    for _ in range(9):
        end, rows = cycle(reader, start)
        again = [row for p in reader.partitions(start, end) for row in reader.read(p)]
        assert [r[0] for r in again] == [r[0] for r in rows]  # as after a restart
        seen, sizes, start = seen + [r[0] for r in rows], [*sizes, len(rows)], end
    assert sizes == [2, 4, 8, 12, 12, 2, 0, 0, 0] and seen == [f"e{k}" for k in range(40)]
