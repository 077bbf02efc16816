"""Turns, extraction batches and retention against brute force and single cases."""

import random

import pytest

from tessera.functions.text import token_estimate
from tessera.operators import sessions as Z

SCHEMA = "conv_id long, pos long, role string, is_tool boolean, text string, tokens long"


def random_messages(seed, n):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for pos in range(rng.randrange(1, 25)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system"])
            rows.append((c, pos, role, rng.random() < 0.3, None, rng.choice([0, 1, 5, 9, 20, 60])))
    return rows


def brute_turns(rows):
    """{conv_id: [(anchor message or None, other messages by step)]} with turn 0 for what comes before any user."""
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        turns = out.setdefault(r[0], [])
        if r[2] == "user" and not r[3]:
            turns.append((r, {}))
            continue
        if not turns:
            turns.append((None, {}))
        steps = turns[-1][1]
        number = max(steps, default=0)
        if r[2] == "assistant" and not r[3]:
            number += 1
        steps.setdefault(number, []).append(r)
    return out


@pytest.mark.parametrize("chunk", [4, 4096])
def test_turns_and_steps(spark, monkeypatch, chunk):
    monkeypatch.setattr(Z, "CHUNK", chunk)
    rows = random_messages(1, 60)
    got = {(r.conv_id, r.pos): (r.turn_no, r.step_no) for r in Z.turns(spark.createDataFrame(rows, SCHEMA)).collect()}
    expected = {}
    for c, turns in brute_turns(rows).items():
        first = 0 if turns[0][0] is None else 1
        for i, (anchor, steps) in enumerate(turns, first):
            if anchor:
                expected[c, anchor[1]] = (i, 0)
            for s, messages in steps.items():
                expected |= {(c, m[1]): (i, s) for m in messages}
    assert got == expected


def brute_batches(rows, most_tokens, most_messages):
    over = lambda ms: sum(m[5] for m in ms) > most_tokens or len(ms) > most_messages
    out = {}
    for c, turns in brute_turns(rows).items():
        units = []
        for anchor, steps in turns:
            every = ([anchor] if anchor else []) + [m for ms in steps.values() for m in ms]
            if not over(every):
                units.append(("turn", every))
                continue
            if anchor:
                units.append(("message", [anchor]))
            for ms in steps.values():
                units += [("message", [m]) for m in ms] if over(ms) else [("step", ms)]
        batch, held = 0, []
        for level, ms in units:
            if held and (over(ms) or over(held + ms)):
                batch, held = batch + 1, []
            held = held + ms
            out[c, ms[0][1]] = (level, sum(m[5] for m in ms), len(ms), batch, over(ms))
    return out


@pytest.mark.parametrize("limits", [(40, 4), (15, 100), (1000, 2), (None, None), (30, None)])
def test_batches_like_brute_force(spark, limits):
    rows = random_messages(2, 500)
    found = Z.extraction_batches(Z.turns(spark.createDataFrame(rows, SCHEMA).repartition(3)), *limits)
    got = {(r.session, r.pos): (r.level, r.tokens, r.messages, r.batch, r.oversized) for r in found.collect()}
    assert got == brute_batches(rows, *(10**9 if x is None else x for x in limits))


def plan(spark, messages, keep, budget):
    df = spark.createDataFrame([(1, i, role, tool, text) for i, (_, role, tool, text) in enumerate(messages)], "conv_id long, pos long, role string, is_tool boolean, text string")
    found = Z.retain(Z.turns(df.withColumn("tokens", token_estimate(df.text))), keep, budget)
    rows = sorted(found.collect(), key=lambda r: r.pos)
    ids = [m[0] for m in messages]
    of = lambda place: [ids[r.pos] for r in rows if r.place == place]
    return of("archive"), of("keep"), [ids[r.pos] for r in rows if r.checkpoint], {ids[r.pos]: r.text for r in rows if r.place == "keep"}, found


def test_ten_steps_stay_with_their_anchor(spark):
    messages = [("u1", "user", False, "investigate"), *((f"a{i}", "assistant", False, f"step {i}") for i in range(10))]
    archive, keep, checkpoint, *_ = plan(spark, messages, 1, 12_000)
    assert (archive, checkpoint) == ([], []) and keep == [m[0] for m in messages]


def test_a_large_turn_keeps_its_anchor_and_whole_last_steps(spark):
    messages = [("u1", "user", False, "investigate")]
    for i in range(6):
        messages += [(f"a{i}", "assistant", False, str(i) * 1000), (f"tr{i}", "user", True, f"result-{i}")]
    archive, keep, checkpoint, *_ = plan(spark, messages, 1, 700)
    assert keep == ["u1", "a4", "tr4", "a5", "tr5"]
    assert archive == ["u1", *(x for i in range(4) for x in (f"a{i}", f"tr{i}"))] and checkpoint == archive[1:]


def test_a_large_last_step_is_archived_and_stays_as_a_preview(spark):
    text = "HEAD-" * 1000 + "TAIL-" * 1000
    archive, keep, checkpoint, texts, found = plan(spark, [("u1", "user", False, "investigate"), ("a1", "assistant", False, text)], 1, 120)
    assert (archive, keep, checkpoint) == (["u1", "a1"], ["u1", "a1"], ["a1"])
    assert texts["u1"] == "investigate" and "HEAD-" in texts["a1"] and "TAIL-" in texts["a1"] and len(texts["a1"]) < len(text)
    assert found.where("place = 'archive' AND pos = 1").first().text == text
    assert Z.active_tokens(found).first().tokens <= 120


def test_a_large_turn_without_an_anchor_is_archived(spark):
    archive, keep, checkpoint, *_ = plan(spark, [(f"a{i}", "assistant", False, "ABC"[i] * 1000) for i in range(3)], 1, 150)
    assert (archive, keep, checkpoint) == (["a0", "a1", "a2"], [], [])


def test_whole_old_turns_go_first(spark):
    words = "first,answer one,second,answer two,third,answer three".split(",")
    messages = [(f"{'ua'[i % 2]}{i // 2 + 1}", ("user", "assistant")[i % 2], False, w) for i, w in enumerate(words)]
    assert plan(spark, messages, 2, 20)[:3] == (["u1", "a1"], ["u2", "a2", "u3", "a3"], [])
    assert plan(spark, messages, 2, 8)[:3] == (["u1", "a1", "u2", "a2"], ["u3", "a3"], [])


def test_a_large_anchor_alone_stays(spark):
    assert plan(spark, [("u1", "user", False, "x" * 900)], 1, 10)[:2] == ([], ["u1"])


def test_previews_share_what_the_anchor_leaves(spark):
    messages = [("u1", "user", False, "q" * 40), ("a1", "assistant", False, "a" * 4000), ("tr1", "user", True, "b" * 400)]
    archive, keep, checkpoint, texts, found = plan(spark, messages, 1, 110)
    assert (archive, keep, checkpoint) == (["u1", "a1", "tr1"], ["u1", "a1", "tr1"], ["a1", "tr1"])
    assert Z.active_tokens(found).first().tokens <= 110 and texts["a1"].startswith("aaa") and texts["tr1"].endswith("b")


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert Z.retain(Z.turns(none), 1, 5).count() == 0 and Z.extraction_batches(Z.turns(none), 5, 5).count() == 0
