"""What a Python worker holds at once is bounded."""

import pyarrow as pa

from arcwright.llm.bytebpe import MAX_UNITS, ByteBpe, UnitMemo, slices, vocabulary_path


def test_pieces_are_bounded():
    texts = [f"{i} " * 4000 for i in range(600)] + ["x" * (6 << 20)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert batch.nbytes > 12 << 20
    pieces = list(slices(iter([batch])))
    assert [t for p in pieces for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or p.nbytes <= 4 << 20 for p in pieces)


def test_memo_starts_anew():
    coder = ByteBpe(vocabulary_path())
    coder.memo = UnitMemo(coder._encode_units, limit=50)
    texts = [" ".join(f"word{i * 7 + k}" for k in range(40)) + "\nend, 3.5!" for i in range(30)]
    held = []
    for t in texts + texts:
        flat, lengths = coder.encode(pa.array([t]))
        assert flat.tolist() == coder.library.encode(t, add_special_tokens=False).ids and lengths.tolist() == [len(flat)]
        held.append(len(coder.memo.known))
    assert max(held) < 250 and MAX_UNITS <= 250_000
