"""What a Python worker holds while it maps texts, and keeps when it goes on to another stage."""

import pandas as pd
import pyarrow as pa

from lumenweave.llm import common as C
from lumenweave.llm import packing, tokens, toxicity


def test_a_batch_becomes_python_objects_slice_by_slice():
    ids = [None, 2**53 + 1, *range(2, 2000)]
    batch = pa.RecordBatch.from_pydict({"i": pa.array(ids, pa.int64()), "t": [None, "\u00e9", *map(str, range(1998))]})
    sizes = []

    def f(batches):
        for rows in batches:
            sizes.append(len(rows))
            yield pd.DataFrame({"t": rows["t"], "i": rows["i"].array})

    out = pa.Table.from_batches(C.slices(f, "i long, t string")(iter([batch, batch.slice(0, 0)])))
    assert max(sizes) <= C.SLICE and sum(sizes) == len(ids)
    assert out["i"].to_pylist() == ids and out["t"].to_pylist() == batch["t"].to_pylist()


def test_tables_of_tokens_go_when_the_worker_goes_on():
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, None], pa.int64()), "text": ["one two", None]})
    pack = C.slices(packing._cut(packing.tokenizer_file(), 4096), "doc_id long, piece int, start long, length long, ids_crc32 long", tokens.KEPT)
    first = list(pack(iter([rows])))
    table = C.WORKER[tokens.KEPT][packing.tokenizer_file()]
    assert list(pack(iter([rows]))) == first and C.WORKER[tokens.KEPT][packing.tokenizer_file()] is table
    list(C.slices(toxicity._features(), "feature string, n long")(iter([rows.select(["text"])])))
    assert not C.WORKER


def test_scores_keep_every_column_as_it_is():
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array([2**53 + 1, None], pa.int64()), "own": [[1], None], "text": ["a", None]})
    (out,) = toxicity._score(None)(iter([rows]))
    assert out.drop_columns("score") == rows.drop_columns("text") and out["score"].to_pylist() == [0.0, 0.0]
