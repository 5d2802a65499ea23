import tracemalloc

import pyarrow as pa

from phishscreen.functions.html import READ
from phishscreen.functions.rows import by_row


def test_values_and_nulls():
    double = by_row(lambda a, b: None if a is None else [a, b], [pa.array(["x", None, "y"]), pa.array(["1", "2", None])], pa.list_(pa.string()))
    assert double.to_pylist() == [["x", "1"], None, ["y", None]] and double.type == pa.list_(pa.string())
    assert by_row(str, [pa.array([], pa.string())], pa.string()).to_pylist() == []
    chunks = by_row(lambda a: {"text": a * 900_000, "hidden": a == "b"}, [pa.array(["a", "b", "c"])], READ)
    assert [(len(r["text"]), r["hidden"]) for r in chunks.to_pylist()] == [(900_000, False), (900_000, True), (900_000, False)]


def test_few_rows_are_python_values_at_a_time():
    """48 MB of texts, of which a pandas function held all as Python strings, and all results too."""
    texts = pa.array(["é" * 50_000] * 480)
    tracemalloc.start()
    by_row(lambda x: {"text": x[1:], "hidden": False}, [texts], READ)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 << 20
