"""Identity by source id, fingerprint, then content, and the versions and states that follow."""

from quillspark.operators import identity as I

COLUMNS = "conv_id long, role string, source_id string, seq long, status string, arrival long, digest string, fingerprint string"


def captures(spark, rows):
    return I.resolved(spark.createDataFrame([(1, *r) for r in rows], COLUMNS))


def test_layers_in_order_and_content_by_the_smallest_place(spark):
    rows = [
        ("user", "s1", 4, "complete", 1, "a", "p1"),
        ("user", None, 2, "complete", 2, "b", "p2"),
        ("user", "s1", 4, "complete", 3, "b", "p3"),  # by source, a second content that another message has too
        ("user", None, 9, "complete", 4, "b", "p4"),  # by content: the message at place 2
        ("user", None, 1, "complete", 5, "c", "p1"),  # by fingerprint, which moves its message to place 1
        ("user", None, 9, "complete", 6, "b", "p5"),  # so that content now means that one
        ("assistant", None, 9, "complete", 7, "b", "p6"),  # another sender: another message
    ]
    got = {r.arrival: (r.message, r.layer, r.version_number, r.outcome) for r in captures(spark, rows).collect()}
    assert got == {1: (1, "none", 1, "new"), 2: (2, "none", 1, "new"), 3: (1, "source", 2, "new"), 4: (2, "content", 1, "identical"), 5: (1, "fingerprint", 3, "new"), 6: (1, "content", 2, "identical"), 7: (7, "none", 1, "new")}


def test_equal_places_go_to_the_message_that_came_first(spark):
    rows = [("user", "s1", 3, "complete", 1, "a", "p1"), ("user", "s2", 3, "complete", 2, "a2", "p2"), ("user", "s2", 3, "complete", 3, "x", "p3"), ("user", "s1", 3, "complete", 4, "x", "p4"), ("user", None, 3, "complete", 5, "x", "p5")]
    assert {r.arrival: r.message for r in captures(spark, rows).collect()}[5] == 1


def test_partial_content_is_promoted_or_superseded_and_a_b_a_adds_nothing(spark):
    rows = [
        ("assistant", "s1", 0, "partial", 1, "a", "p1"),
        ("assistant", "s1", 0, "partial", 2, "b", "p2"),
        ("assistant", "s1", 0, "complete", 3, "b", "p3"),
        ("assistant", "s1", 0, "complete", 4, "b", "p4"),
        ("assistant", "s1", 0, "partial", 5, "a", "p5"),
        ("assistant", "s2", 1, "unknown", 6, "c", "p6"),
        ("assistant", "s2", 1, "complete", 7, "c", "p7"),
    ]
    own = captures(spark, rows)
    versions = {(r.message, r.version_number): (r.digest, r.version_status, r.superseded_by, r.captures, r.is_regeneration) for r in I.message_versions(own).collect()}
    assert versions == {(1, 1): ("a", "partial", 2, 2, False), (1, 2): ("b", "reconciled", 0, 3, True), (6, 1): ("c", "unknown", 0, 2, False)}
    state = {r.message: (r.current_digest, r.latest_complete, r.status, r.captures, r.identical, r.reconciled) for r in I.messages(own).collect()}
    assert state == {1: ("b", 2, "complete", 5, 2, 1), 6: ("c", 0, "unknown", 2, 1, 0)}


def test_null_fields_and_an_empty_table(spark):
    got = captures(spark, [(None, None, None, None, 1, None, None), (None, "", None, "complete", 2, None, None)]).collect()
    assert [(r.message, r.layer) for r in sorted(got, key=lambda r: r.arrival)] == [(1, "none"), (1, "fingerprint")]
    assert captures(spark, []).count() == 0 and I.messages(captures(spark, [])).count() == 0
