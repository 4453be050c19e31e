"""What Python holds of pages at a time doesn't grow with the rows of a batch."""

import pyarrow as pa

from quillspark.operators.allowed_markup import with_sanitised
from quillspark.operators.bodies import read_pages
from quillspark.operators.markup import strict_markup

SIZES = [40_000] * 100 + [3_000_000] + [10] * 400


class Rows:
    """A table whose mapInArrow gives what a task would yield for one batch."""

    def __init__(self, key):
        html = [f"<p>{i}</p>" + "x" * n for i, n in enumerate(SIZES)]
        self.batch = pa.RecordBatch.from_arrays([pa.array(range(len(SIZES)), pa.int64()) if key == "page_id" else pa.array(map(str, range(len(SIZES)))), pa.array(html)], [key, "html"])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return [b.column(0).to_pylist() for b in run(iter([self.batch, self.batch.slice(0, 0)]))]


def sliced(found):
    assert [int(x) for part in found for x in part] == list(range(len(SIZES))) and max(map(len, found)) <= 100


def test_pages_are_read_in_slices(spark):
    sliced(read_pages(Rows("page_id")))


def test_markup_is_read_in_slices():
    sliced(strict_markup(Rows("page_id")))
    sliced(with_sanitised(Rows("key")))
