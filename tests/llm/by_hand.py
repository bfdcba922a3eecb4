"""The steps of the suffix job on lists of rows, in this process."""

import pyarrow as pa

from logquarry.llm import suffixes as s


def without_repeats(docs, parts=5, tasks=3):
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["doc_id", "text"])

    def run(step, batches):
        return [r for b in batches for out in step(iter([b])) for r in zip(*(c.to_pylist() for c in out.columns), strict=True)]

    def dealt(rows):
        return [s._batch(sorted((r for r in rows if r[0] % 3 == q), key=lambda r: r[:2])) for q in range(3)]

    read = [batch(docs[i::tasks]) for i in range(tasks)]
    runs = run(s._sort_runs(parts), dealt(run(s._find_runs(parts), read)))
    texts = run(s._pack_texts(parts), read)
    windows = run(s._sort_windows(parts), dealt(run(s._find_windows(parts), dealt(texts + [r for r in runs if r[1] == s.ASK]))))
    return run(s._cut, dealt(texts + [r for r in runs if r[1] == s.MARK] + windows))
