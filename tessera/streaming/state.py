"""Keyed streaming state of the question stream: conversation histories and task memories.

Both processors keep a bounded tail per key in the state store, read it once per key and
micro-batch, and write it back once. The rows of a key in one micro-batch are put in order in
memory; ``maxFilesPerTrigger`` of the source bounds them. Across micro-batches order is arrival.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

MESSAGE = "turn long, role string, text string"
ENTRY = "seq long, type string, text string, vec array<double>"


def _ordered(rows, by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


class ConversationTail(StatefulProcessor):
    """Per conversation the last ``keep`` messages: user messages leave with the ones before them.

    In: (conv_id; turn, role, text, *passed). Out: the user rows with ``history``, an array of
    (turn, role, text). A null role counts as user in the history, a null text as empty.
    """

    def __init__(self, keep: int, passed: list[str]):
        self.keep, self.passed = keep, passed

    def init(self, handle) -> None:
        self.tail = handle.getListState("tail", MESSAGE)

    def handleInputRows(self, key, rows, timerValues):
        tail = [tuple(m) for m in self.tail.get()]
        out = []
        for r in _ordered(rows, ["turn"]).to_dict("records"):
            if r["role"] == "user":
                history = [{"turn": t, "role": who, "text": said} for t, who, said in tail]
                out.append({**{c: r[c] for c in ["conv_id", "turn", "text", *self.passed]}, "history": history})
            said = (int(r["turn"]), "user" if r["role"] is None else r["role"], "" if r["text"] is None else r["text"])
            tail = [*tail, said][-self.keep:]
        self.tail.put(tail)
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


class MemoryTail(StatefulProcessor):
    """Per memory key the last ``keep`` entries and the next ``seq``: a question sees them, then adds its own two.

    In: (key; conv_id, turn, mode, query_vec, qa_text, qa_vec, *passed). Out: the passed columns with
    ``pos``, the last ``seq`` that the question may see, and ``window``, the entries up to there. Rows of
    another mode than ``rag`` pass without a window and leave no entry. The tail starts with ``initial``
    rows (key; seq, type, text, vec) if there are any: their last ones by ``seq``.
    """

    def __init__(self, keep: int, passed: list[str]):
        self.keep, self.passed = keep, passed

    def init(self, handle) -> None:
        self.tail = handle.getListState("tail", ENTRY)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = initialState.sort_values("seq", kind="stable").to_dict("records")[-self.keep:]
        old = [tuple(m) for m in self.tail.get()]  # a key's rows may come in several frames
        new = [(int(r["seq"]), r["type"], r["text"], None if r["vec"] is None else [float(x) for x in r["vec"]]) for r in rows]
        self.tail.put(sorted([*old, *new], key=lambda e: e[0])[-self.keep:])

    def handleInputRows(self, key, rows, timerValues):
        tail = [(m[0], m[1], m[2], None if m[3] is None else list(m[3])) for m in self.tail.get()]
        out = []
        for r in _ordered(rows, ["conv_id", "turn"]).to_dict("records"):
            row = {c: r[c] for c in ["conv_id", "turn", *self.passed]}
            if r["mode"] != "rag":
                out.append({**row, "pos": -1, "window": []})
                continue
            pos = tail[-1][0] if tail else -1
            out.append({**row, "pos": pos, "window": [dict(zip(("seq", "type", "text", "vec"), e)) for e in tail]})
            tail = [*tail, (pos + 1, "query", r["text"], [float(x) for x in r["query_vec"]]),
                    (pos + 2, "qa", r["qa_text"], [float(x) for x in r["qa_vec"]])][-self.keep:]
        if tail:
            self.tail.put(tail)
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass
