"""Ordered rules: the first that fails decides."""

import hashlib

from pyspark.sql import functions as F

from quillspark.operators import attachments as A
from quillspark.operators import policy as P

WORKSPACE = "n int, kind string, verified boolean, signals array<string>, workspace_id string, label string, allowed_ids array<string>, allowed_label string"


def test_workspaces(spark):
    cases = [
        (("personal", True, ["workspace_id_match"], "w", "L", ["w"], "L"), "personal_workspace_blocked"),
        (("managed_company", True, ["workspace_id_match"], " w ", None, [" w", ""], None), "workspace_id_allowlisted"),
        (("managed_company", True, ["workspace_label_match", "odd"], "w", None, ["w"], None), "workspace_id_allowlisted"),
        (("managed_company", True, ["enterprise_workspace_marker"], "w", None, ["w"], None), "workspace_signal_missing"),
        (("managed_company", True, None, "w", None, ["w"], None), "workspace_signal_missing"),
        (("managed_company", True, ["workspace_id_match"], "v", " l", ["w"], "L"), "workspace_not_allowlisted"),
        (("managed_company", True, ["workspace_id_match"], "", " l", ["w"], "L"), "workspace_not_allowlisted"),
        (("managed_company", True, ["workspace_id_match"], "v", " l", [" "], "L "), "workspace_label_matched"),
        (("managed_company", True, ["workspace_id_match"], "v", "m", None, "L "), "workspace_label_mismatch"),
        (("managed_company", True, [], "v", "l", None, "L"), "workspace_signal_missing"),
        (("managed_company", True, ["workspace_id_match"], "w", "l", [], " "), "workspace_policy_unconfigured"),
        (("managed_company", None, ["workspace_id_match"], "w", "l", ["w"], "L"), "workspace_unverified"),
        (("odd", True, ["workspace_id_match"], "w", "l", ["w"], "L"), "workspace_unverified"),
        ((None, True, ["workspace_id_match"], "w", "l", ["w"], "L"), "workspace_unverified"),
    ]
    df = spark.createDataFrame([(n, *row) for n, (row, _) in enumerate(cases)], WORKSPACE)
    got = df.select("n", P.workspace_reason().alias("r"), P.accepted(P.workspace_reason()).alias("ok")).orderBy("n").collect()
    assert [r.r for r in got] == [want for _, want in cases] and sum(r.ok for r in got) == 3


def test_gates(spark):
    rows = [(True, True, True, True), (None, None, True, True), (False, True, False, True), (False, True, True, None), (None, True, True, True)]
    df = spark.createDataFrame(rows, "kill_switch boolean, capture_enabled boolean, authorized boolean, attachments_enabled boolean")
    got = df.select(P.capture_gate().alias("a"), P.capture_gate(attachments=True).alias("b")).collect()
    assert [tuple(r) for r in got] == [("kill_switch_active",) * 2, ("capture_disabled",) * 2, ("authorization_not_confirmed",) * 2, (None, "attachments_disabled"), (None, None)]


def test_kinds_by_bytes_and_declaration(spark):
    long = ("é" * 40_000).encode()
    cases = [
        (b"RIFF\0\0\0\0WEBPx", "image/webp", "image/webp"), (b"RIFF\0\0\0\0WAVEx", "image/webp", None), (b"RIFF\0\0\0\0WAVEx", "text/plain", "text/plain"), (b"GIF87a", None, "image/gif"), (b"%PDF", "application/pdf", None), (b"%PDF-", None, "application/pdf"),
        (b"PK\x03\x04", A.SHEET, A.DOCUMENT), (b"\xff\xd8\xff\xe0", "text/plain", "image/jpeg"), (b"", "text/csv", "text/csv"), (b"", None, None), (b"a,b", "text/csv", "text/csv"), (b"a\xff", "application/json", None), (b"plain", "image/png", None),
        (long, "text/plain", "text/plain"), (b"a" + long, "text/plain", None), (None, "text/plain", None),
    ]
    df = spark.createDataFrame([(n, a, b) for n, (a, b, _) in enumerate(cases)], "n int, data binary, mime string")
    assert [r.k for r in df.select("n", A.detected(F.col("data"), F.col("mime")).alias("k")).orderBy("n").collect()] == [want for *_, want in cases]  # a sample that cuts a character fails, as there


def test_announcements(spark):
    cases = [("a.PNG", "image/png", 10, None), ("a.png.exe", "image/png", 10, "extension_mismatch"), ("noext", "text/plain", 10, "extension_mismatch"), ("../x.md", "text/markdown", 10, None), ("a.png", "image/png", 101, "attachment_too_large"), ("a.sh", "text/x-sh", 10, "mime_type_not_allowed"), ("a", None, None, "mime_type_not_allowed")]
    df = spark.createDataFrame([(n, f, m, s, False, before) for n, (f, m, s, _) in enumerate(cases) for before in (None, "clean", "rejected")], "n int, filename string, mime string, byte_size long, metadata_only boolean, before string")
    for r in A.announced(df, 100).collect():
        want = cases[r.n][3]
        assert r.refused == want and r.duplicate == (want is None and r.before == "clean")
        assert r.state == (r.before if want or r.before == "clean" else "pending")


def test_transitions_leave_what_they_dont_apply_to(spark):
    body = b"hello"
    digest = hashlib.sha256(body).hexdigest()
    kinds = "state string, reason string, owner string, by string, sha256 string, said_sha256 string, byte_size long, said_size long, expires_at long, at long, found long, mime string, data binary"
    row = {"state": "pending", "reason": "r", "owner": "o", "by": "o", "sha256": digest, "said_sha256": digest, "byte_size": 5, "said_size": 5, "expires_at": 1000, "at": 1900, "found": 5, "mime": "text/plain", "data": body}
    run = lambda f, **more: next(iter(map(lambda r: (r.state, r.reason), f(spark.createDataFrame([tuple((row | more).values())], kinds)).collect())))  # noqa: C417, E731
    assert run(A.completed) == ("quarantine", None) and run(A.completed, said_sha256=None) == ("pending", "r")
    assert run(A.completed, at=1901) == ("expired", "upload_expired") and run(A.completed, expires_at=None) == ("quarantine", None)
    assert run(A.completed, owner=None, by="x", said_size=6, state="clean") == ("clean", "already_clean")
    assert run(A.finalised, state="quarantine") == ("clean", None) and run(A.finalised) == ("pending", "r") and run(A.finalised, state="quarantine", data=None) == ("quarantine", "r")
    assert run(A.finalised, state="quarantine", data=b"hellO") == ("rejected", "sha256 mismatch between declared and stored bytes")
    late = lambda df: A.expired(df, F.lit(4601))
    assert run(late) == ("expired", "never uploaded before the presigned URL expired") and run(late, state="quarantine") == ("quarantine", "r") and run(late, expires_at=1001) == ("pending", "r")
