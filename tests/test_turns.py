"""Repeated turns by role and whole wording."""

import pyarrow as pa
import pyarrow.parquet as pq
from parlance.plans import catalogue


def test_surplus_turns_compare_whole_turns(spark, tmp_path):
    turns = [
        ("system", "please wait here"),
        ("user", "Good morning doctor, my knee hurts"),
        ("user", "Good morning doctor, my head aches"),
        ("assistant", "I see"),
        ("user", "I see"),
        ("assistant", "Good morning to you"),
        ("system", "Please wait, here!"),
        ("assistant", "Good morning to you"),
    ]
    conversations = {"conv_id": [1] * len(turns), "turn": list(range(len(turns))), "role": [r for r, _ in turns], "text": [t for _, t in turns]}
    pq.write_table(pa.table(conversations), tmp_path / "conversations.parquet")
    got = catalogue.QUERIES["oh7_surplus_turns"](spark, str(tmp_path)).collect()
    assert [(str(r.session_id), r.norm, r.surplus) for r in got] == [("1", "please wait here", 1)]
