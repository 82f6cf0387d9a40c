import hashlib
import zlib
from collections import defaultdict

import pytest

from glossaloom.llm import talktrie

ROWS = "conv_id long, turn long, role string, text string, key string, depth int"


def rebuilt_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(c % 5 if c >= 0 else -(-c % 5)), [])[:h] + turns[h:]
    return made


def trie_by_hand(talks):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    nodes = {}
    for key, who in members.items():
        inside = [k for k in members if k[: len(key)] == key]
        children = [k for k in members if len(k) == len(key) + 1 and k[:-1] == key]
        childless = [k for k in inside if not any(len(m) == len(k) + 1 and m[:-1] == k for m in members)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in inside if k)
        listed = ",".join(map(str, sorted(ends[key])))
        nodes[min(who), len(key)] = (
            min(members[key[:-1]]) if key else None, len(who), len(children), len(childless), saved, hashlib.sha256(listed.encode()).hexdigest()
        )
    return nodes


def got(frame):
    rows = frame.collect()
    made = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(made) == len(rows)
    return made


def cases():
    rows = []
    for c in range(-7, 60):
        start = [("system", "same"), ("user", "hello"), ("assistant", "ü" * 9)][: c % 4]
        for turn, (role, text) in enumerate([*start, *[("user", f"q{c % 3}"), ("assistant", f"a{c % 7}")] * (c % 3)]):
            rows.append((c, turn, role, text, "k", 1))
    rows += [(100, None, "user", "first", "", 1), (100, 5, None, None, "", 1), (100, 5, None, None, "", 1), (100, 5, "user", "tie b", "", 1), (100, 5, "user", "tie a", "", 1)]
    rows += [(101, 1, "user", "x" * 300_000, "", 1), (None, 0, "user", "nobody's", "", 1), (2**62, 0, "user", "", "", 1)]
    return rows


@pytest.mark.parametrize("span", [talktrie.SPAN, 2])
def test_nodes_equal_a_sequential_model(spark, span, monkeypatch):
    monkeypatch.setattr(talktrie, "SPAN", span)
    rows = cases()
    turns, lengths = talktrie.rebuilt(talktrie.numbered(spark.createDataFrame(rows, ROWS)))
    assert got(talktrie.prefix_trie(turns, lengths)) == trie_by_hand(rebuilt_by_hand(rows))


def test_conversations_as_they_are_and_the_last_turn(spark):
    rows = [(1, 0, "user", "a", "", 1), (1, 1, "assistant", "b", "", 1), (2, 0, "user", "a", "", 1), (3, 0, "user", "c", "", 1)]
    nodes = talktrie.prefix_trie(*talktrie.whole(talktrie.numbered(spark.createDataFrame(rows, ROWS))))
    assert got(nodes) == trie_by_hand({1: [("user", "a"), ("assistant", "b")], 2: [("user", "a")], 3: [("user", "c")]})
    last = {(r.conv_id, r.depth): (r.role, r.text_sha256) for r in nodes.collect()}
    assert last[1, 2] == ("assistant", hashlib.sha256(b"b").hexdigest()) and last[1, 0] == (None, None)


def test_end_lists_run_over_many_blocks_and_an_empty_table_has_no_node(spark, monkeypatch):
    monkeypatch.setattr(talktrie, "BLOCK_BITS", 2)
    rows = [(c, 0, "user", "same", "", 1) for c in range(-30, 90, 3)]
    made = got(talktrie.prefix_trie(*talktrie.whole(talktrie.numbered(spark.createDataFrame(rows, ROWS)))))
    listed = ",".join(str(c) for c in range(-30, 90, 3))
    assert made[-30, 1][1:] == (40, 0, 1, 39 * 4, hashlib.sha256(listed.encode()).hexdigest())
    empty = spark.createDataFrame([], ROWS)
    assert talktrie.prefix_trie(*talktrie.rebuilt(talktrie.numbered(empty))).count() == 0
