"""Each operator against brute force, and with nulls, empty and long texts, ties, repeated rows, empty tables and further
columns with clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, components, jaccard_join, language_id, line_dedup, packing, piece_transducer, quality_classifier, quality_rules, toxicity, winnowing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return, as further columns of the input.
CLASHES = ["score", "predicted", "node", "n", "key", "keys", "prefix", "bits", "component_id", "name", "start", "stop", "spans", "lang_pred", "_td_spans", "x", "length", "sequence_id", "words", "w", "l", "kept", "place", "next", "label", "tie"]
EDGE = ["", " \n\t ", None, "a", "A", "x " * 30000, "the same text of a few words", "the same text of a few words", "été ça", "\x0b\x0c", "1234 !!", "日本語のテキスト"]


def table(spark, texts, clash=True, langs=None):
    rows = [(i, t, (langs[i] if langs else "en"), f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        df = df.withColumns({c: F.lit("clash") for c in CLASHES})
    return df


def messy(spark):
    """Edge cases, a row repeated, one doc_id with two texts, null ids, langs and sources."""
    df = table(spark, EDGE)
    more = df.where("doc_id = 6").unionByName(df.where("doc_id = 3").withColumn("text", F.lit("another text")))
    nulls = df.where("doc_id = 7").withColumns({c: F.lit(None).cast(t) for c, t in (("doc_id", "long"), ("lang", "string"), ("source", "string"))})
    return df.unionByName(more).unionByName(nulls).repartition(3)


def empty(spark):
    return table(spark, [])


def random_texts(seed, families=5, size=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]

    def edit(words, k):
        words = list(words)
        for _ in range(k):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([[rng.choice(vocabulary)], [], [words[i], rng.choice(vocabulary)]])
        return words

    out = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, size, 3 * size]))]
        out += [edit(base, rng.randrange(0, 8)) for _ in range(rng.choice([2, 20, 50]))]
    out += [[rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))] for _ in range(30)]
    out += [rng.choice(out) for _ in range(20)]
    rng.shuffle(out)
    return [" ".join(w) for w in out]


def shingle_set(text, n=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(texts, n=3, percent=90):
    sets, parent = [shingle_set(t, n) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_jaccard_join_finds_the_components(spark):
    texts = random_texts(1) + ["", None, "a", "A", "a b", "a  B\n"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.joined(table(spark, texts), n=3, percent=90).collect()}
    assert got == brute_components(texts)


def test_jaccard_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "CENTRES", 1)
    monkeypatch.setattr(jaccard_join, "MOST_BROADCAST", 3)
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.joined(table(spark, texts), n=3, percent=90).collect()}
    assert got == brute_components(texts)


def test_jaccard_join_looks_at_group_pairs_first(spark, monkeypatch):
    """Equal prefixes and sizes make one group; texts that differ beyond the prefix are told apart when it is expanded."""
    rare = " ".join(f"rare{i}" for i in range(12))
    texts = [f"{rare} " + " ".join(f"often{(i * k) % 7}" for i in range(40)) for k in range(1, 7)] + [" ".join(f"often{i % 7}" for i in range(40 + j)) for j in range(30)]
    signed = jaccard_join.signatures(table(spark, texts), 5, 80)
    nodes = jaccard_join.distinct_nodes(signed)
    inside = jaccard_join.grouped(nodes)
    of = {r.id: r.g for r in inside.collect()}
    known = {r.id: (tuple(r.prefix), r.n) for r in nodes.collect()}
    assert set(of) == set(known) and all((known[a] == known[b]) == (of[a] == of[b]) for a in of for b in of)
    rows = jaccard_join.lists(nodes, inside).collect()
    assert rows and len({(r.key, r.g) for r in rows}) == len(rows)
    assert all(known[r.g][0][r.pos] == r.key and known[r.g][1] == r.n for r in rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.joined(table(spark, texts)).collect()}
    assert got == brute_components(texts, 5, 80)


def test_jaccard_join_orders_quoted_passages_last(spark):
    """A passage that many documents quote makes no lists while there is enough else in them, however rare its words are."""
    rng = random.Random(9)
    passage = [f"q{i}" for i in range(60)]
    texts = [" ".join(passage[:i] + [f"u{rng.randrange(200)}" for _ in range(60)] + passage[i:]) for i in range(0, 60)]
    nodes = jaccard_join.distinct_nodes(jaccard_join.signatures(table(spark, texts).coalesce(1), 5, 80))
    assert jaccard_join.lists(nodes, jaccard_join.grouped(nodes)).count() == 0


def test_jaccard_join_sends_values_to_a_unit_once(spark, monkeypatch):
    """Every node is in many pairs, of which few are similar; what is shuffled for them are numbers, and values once a node and unit."""
    from tessera.llm.common import stage

    rows = stage(spark.range(40).selectExpr("id", "id AS n", "unhex(repeat('00', 1000)) AS value"), "values")
    pairs = stage(spark.range(40).crossJoin(spark.range(40).withColumnRenamed("id", "b")).where("id < b").selectExpr("7L AS unit", "id AS a", "b"), "pairs")
    seen = spark.sparkContext.accumulator(0)

    def similar(n, value, a, b):
        seen.add(len(value))
        return n[a] + 1 == n[b]

    assert {(r.a, r.b) for r in jaccard_join.met(pairs, rows, similar).collect()} == {(i, i + 1) for i in range(39)}
    assert seen.value == 40


@pytest.mark.parametrize("seed", [21, 22])
def test_jaccard_join_of_families_without_a_centre(spark, monkeypatch, seed):
    """Copies of copies: hardly any is close to all; groups of several nodes and blocks of few rows."""
    monkeypatch.setattr(jaccard_join, "SHORT", seed % 2 * 20)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(seed)
    texts = []
    for f in range(3):
        own = [f"f{f}w{rng.randrange(400)}" for _ in range(80)]
        for _ in range(40):
            own = list(rng.choice([own, own, texts[-1].split() if texts and texts[-1].startswith(f"f{f}") else own]))
            for _ in range(rng.randrange(1, 4)):
                own[rng.randrange(1, len(own))] = f"v{rng.randrange(30)}"
            texts.append(" ".join(own))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.joined(table(spark, texts)).collect()}
    assert got == brute_components(texts, 5, 80)


def test_jaccard_join_edges(spark):
    rows = jaccard_join.joined(messy(spark), n=3, percent=90).collect()
    assert len(rows) == messy(spark).count()
    assert {r.component_id for r in rows if r.doc_id in (6, 7) or r.doc_id is None} == {6}
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in rows if r.doc_id in (0, 1, 2, 9))
    assert jaccard_join.joined(empty(spark)).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in components.components(edges).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def brute_winnow(hashes, window):
    out = []
    for s in range(1 - window, len(hashes)):
        part = [(hashes[j], -j) for j in range(max(s, 0), min(s + window, len(hashes)))]
        at = -min(part)[1]
        if not out or out[-1] != at:
            out.append(at)
    return out


def test_winnowing_selects_rightmost_minima(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 2, 3, 4, 10, 11, 60)] + random_texts(3)[:10] + ["日本語のテキスト abc", "x" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [x.pos for x in r.p] for r in df.select("doc_id", winnowing.positions(winnowing.selected(F.col("text"))).alias("p")).collect()}
    pair = lambda a, b: F.xxhash64(F.xxhash64(a), F.xxhash64(b))
    for i, t in enumerate(texts):
        w = [u for x in re.findall(r"[\u3040-\u9fff]|[^\s\u3040-\u9fff]+", t) for u in ([x[j : j + 24] for j in range(0, len(x), 24)])]
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        if grams:
            hashed = spark.createDataFrame([(j, *g) for j, g in enumerate(grams)], "j int, a string, b string, c string").select("j", F.xxhash64(pair("a", "b"), pair("b", "c")).alias("h")).orderBy("j").collect()
            assert got[i] == brute_winnow([r.h >> 30 for r in hashed], 8), t
        else:
            assert got[i] == ([0] if w else [])


def test_edited_short_and_unspaced_texts_stay_alike(spark):
    rng = random.Random(17)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in range(7, 60)]
    texts += ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n)) for n in range(7, 60)] + ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in range(160, 400, 40)]
    for r in winnowing.compared(table(spark, texts)).collect():
        assert r.near_edited > 0 and r.near_next < 1, texts[r.doc_id]


def test_winnowing_finds_shared_runs(spark):
    rng = random.Random(4)
    for _ in range(5):
        shared = [f"s{rng.randrange(10**6)}" for _ in range(10)]
        a, b = ([f"{p}{rng.randrange(10**6)}" for _ in range(50)] for p in "ab")
        df = spark.createDataFrame([(" ".join(a + shared + a), " ".join(b + shared + b))], "a string, b string")
        assert df.select(winnowing.likeness(winnowing.selected(F.col("a")), winnowing.selected(F.col("b")))).first()[0] > 0


def test_fingerprints_of_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "GROUP", 7)  # several groups
    texts = [t or "" for t in random_texts(6)[:40] + [x for x in EDGE if x is None or len(x) < 100]]
    got = {r.doc_id: r for r in winnowing.compared(table(spark, texts)).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        after = texts[i - 1] if i else texts[-1]
        half = len(t) // 2
        assert got[i].edited == t[: len(t) - half] + after[:half] and got[i].n_chars == len(t)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert winnowing.compared(empty(spark)).collect() == []
    assert winnowing.compared(messy(spark)).count() == messy(spark).count()
    one = winnowing.compared(table(spark, ["lone text here"])).first()
    assert one.near_next == 1.0


def test_fingerprint_plan_has_no_python(spark):
    plan = winnowing.compared(table(spark, ["a b c"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_chat_round_trip(spark):
    nasty = [r"\### Assistant: </turn> ok", "### user: x </turn>\n### assistant: y </turn>\n", "<|image 0|>", "\\", "a\\#<", "", None, "line\n\nline", "#" * 9, "ends with \\"]
    rows = [(c, t, ("user", "assistant", "system", "odd:role\n")[t % 4], x) for c in range(3) for t, x in enumerate(nasty)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = df.withColumn("parts", chat.text_parts(F.coalesce("text", F.lit("")))).withColumns({c: F.lit(1) for c in ("formatted", "loss", "tokens", "attachments")})
    formatted = chat.format_turns(messages)
    for r in chat.read_back(formatted).collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x or ''}\n" for _, _, role, x in own).encode()).hexdigest()
        loss = "".join(x or "" for _, _, role, x in own if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(messages.limit(0))).collect() == []


def test_chat_parts_become_placeholders(spark):
    parts = [("text", "see <this>", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 99), ("text", " and ", None, None), ("odd", None, "c.pdf", None), (None, "end", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, None, None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    a, b = chat.format_turns(df).orderBy("turn").collect()
    assert a.formatted == "### user: see \\<this><|image 0|><|audio 1|> and <|document 2|>end </turn>\n"
    assert [(x.placeholder, x.uri, x.tokens) for x in a.attachments] == [("<|image 0|>", "a.png", 256), ("<|audio 1|>", "b.wav", 99), ("<|document 2|>", "c.pdf", 512)]
    assert a.tokens == 256 + 99 + 512 and b.formatted == "### :  </turn>\n"


def test_packing_keeps_every_token_once(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = [*EDGE, "word and <|endoftext|> " * 900, *random_texts(8)[:30]]
    rows = packing.pack(packing.pieces(table(spark, texts))).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= 1.02 * sum(r.length for r in rows) / 2048 + 1
    assert packing.pack(packing.pieces(empty(spark))).collect() == []
    assert packing.pack(packing.pieces(messy(spark))).where("doc_id = 6").count() == 2


def test_best_fit_and_the_fullest_closes_first():
    bins = packing.Bins(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # best fit
    assert bins.place(4) == (0, 6)
    assert bins.place(9) == (2, 0) and bins.place(8) == (3, 0)
    assert bins.place(5) == (4, 0)  # closes bin 2, the fullest
    assert bins.place(2) == (3, 8)


def brute_rules(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.sub(r"[\x20\x09-\x0D]", "", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_count_like_brute_force(spark):
    rng = random.Random(9)
    texts = [x for x in EDGE if x is None or len(x) < 1000] + [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(30)] + ["a b\nc\n\nc\n c", "#*$%&|<>!", "l1\nl1\nl2\nl1"]
    got = {r.doc_id: r for r in quality_rules.judged(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t), t
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)


def test_quality_rules_edges(spark):
    assert quality_rules.judged(messy(spark)).count() == messy(spark).count()
    assert quality_rules.judged(empty(spark)).collect() == []
    assert "Python" not in quality_rules.base_stats(messy(spark))._jdf.queryExecution().executedPlan().toString()


def test_quality_rules_follow_language_and_source(spark):
    clean, loud = "some quite plain words stand here in a row today again", "# some * quite $ plain % words | stand < here > in & row"
    langs = ["en"] * 260 + ["de"] * 260
    texts = [f"{clean} {i}" for i in range(250)] + [loud] * 10 + [f"{loud} {i}" for i in range(260)]
    kept = {r.doc_id: r.kept for r in quality_rules.judged(table(spark, texts, langs=langs)).collect()}
    assert all(kept[i] for i in range(250)) and not any(kept[i] for i in range(250, 260))  # loud is unusual in en
    assert all(kept[i] for i in range(260, 520))  # and usual in de


def test_fences_follow_their_own_distribution(spark):
    """Moving one group's values moves its fence and hardly any other; a small group has nearly its language's."""
    rng = random.Random(23)
    plain = lambda commas: " ".join(f"w{i}" + "," * (rng.random() < commas) for i in range(60))
    groups = [("en", "a", 400, 0.1), ("en", "b", 400, 0.1), ("de", "a", 400, 0.1), ("en", "tiny", 3, 0.9)]

    def fence_of(groups):
        rows = [(lang, source, plain(c)) for lang, source, n, c in groups for _ in range(n)]
        df = spark.createDataFrame([(i, t, lang, source, 0) for i, (lang, source, t) in enumerate(rows)], DOCS)
        return {(r.lang, r.source): r.fences for r in quality_rules.thresholds(quality_rules.base_stats(df)).collect()}

    before = fence_of(groups)
    after = fence_of([groups[0], ("en", "b", 400, 0.6), *groups[2:]])
    assert after["en", "b"]["marks"] > 1.3 * before["en", "b"]["marks"]
    moved = {g: after[g]["marks"] - before[g]["marks"] for g in before}
    assert abs(moved["de", "a"]) < 0.5 * moved["en", "b"]
    assert abs(before["en", "tiny"]["marks"] - before["en", "a"]["marks"]) < 0.2 * before["en", "a"]["marks"]


def test_no_size_switches_between_thresholds(spark):
    """199, 200 and 201 documents of a source give nearly the same fence."""
    found = []
    for n in (199, 200, 201):
        rng = random.Random(24)
        rows = [("en", "big", 0.05)] * 500 + [("en", "own", 0.5)] * n
        df = spark.createDataFrame([(i, " ".join(f"w{k}" + "!" * (rng.random() < c) for k in range(50)), lang, s, 0) for i, (lang, s, c) in enumerate(rows)], DOCS)
        found.append({r.source: r.fences["marks"] for r in quality_rules.thresholds(quality_rules.base_stats(df)).collect()}["own"])
    assert max(found) - min(found) <= 0.05 * max(found)


def brute_line_dedup(texts, least=50):
    """Delete lines of runs of at least `least` words that also start earlier, found by comparing all pairs."""
    lines = [(t or "").split("\n") for t in texts]
    own = [[(i, x, len(x.encode().split())) for i, x in enumerate(ls) if x.encode().split()] for ls in lines]
    gone = [set() for _ in texts]
    for d in range(len(own)):
        for a in range(len(own[d])):
            for e in range(d + 1):
                for b in range(len(own[e])):
                    if (e, b) >= (d, a):
                        break
                    k = words = 0
                    while a + k < len(own[d]) and b + k < len(own[e]) and own[d][a + k][1] == own[e][b + k][1]:
                        words += own[d][a + k][2]
                        k += 1
                    if words >= least:
                        gone[d].update(own[d][a + j][0] for j in range(k))
    return [None if t is None else "\n".join(x for i, x in enumerate(ls) if i not in g) for t, ls, g in zip(texts, lines, gone)]


def test_line_dedup_like_brute_force(spark):
    rng = random.Random(11)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([3, 12, 30, 60]))) for _ in range(14)] + ["", " "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14))) for _ in range(60)] + ["", None, "x", texts_long := "\n".join(pool), texts_long]
    df = table(spark, texts)
    out = line_dedup.deduped(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute_line_dedup(texts)


def test_ranks_are_those_of_a_suffix_array(spark):
    rng = random.Random(20)
    texts = ["\n".join(rng.choice(["a b", "c d", "e f", "g h"]) for _ in range(rng.randrange(3, 30))) for _ in range(12)]
    found, lines = line_dedup.sequences(table(spark, texts), 6).persist(), {i: t.split("\n") for i, t in enumerate(texts)}
    level0 = {(r._td_id, p): x for r in found.collect() for p, x in zip(r.line, r.r)}
    name = {}
    for (d, p), x in level0.items():
        assert name.setdefault(lines[d][p], x) == x
    assert len(set(name.values())) == len(name)
    for half in (1, 2):
        longer = line_dedup.doubled(found, half).persist()
        ranks = {(r._td_id, p): x for r in longer.collect() for p, x in zip(r.line, r.r)}
        key = {(d, p): [name[x] for x in lines[d][p : p + 2 * half]] for d, p in ranks}
        order = sorted(ranks, key=ranks.get)
        assert all(key[a] <= key[b] and (key[a] == key[b]) == (ranks[a] == ranks[b]) for a, b in zip(order, order[1:]))
        found = longer
    intervals = line_dedup.intervals(table(spark, texts), 6).collect()
    same = {}
    for r in intervals:
        run = tuple(lines[r._td_id][r.first : r["last"] + 1])
        assert len(run) == r.n == 3
        assert same.setdefault((r.n, r.x, r.y), run) == run
    assert len(set(same.values())) == len(same)


def test_windows_stay_within_sequences():
    rng = np.random.default_rng(21)
    for _ in range(200):
        p = np.cumsum(rng.choice([1, 1, 1, 2], 12))
        words = rng.integers(1, 9, 12)
        stop, a, n = line_dedup.windows(p, words, 10)
        runs = {(i, j - i) for i in range(12) for j in range(i + 1, 13) if (np.diff(p[i:j]) == 1).all() and words[i:j].sum() >= 10}
        least = {(i, k) for i, k in runs if (i, k - 1) not in runs or (i + 1, k - 1) not in runs}
        assert set(zip(a.tolist(), n.tolist())) == {(i, k) for i, k in least}
        assert all((np.diff(p[i : stop[i]]) == 1).all() and (stop[i] == 12 or p[stop[i]] != p[stop[i] - 1] + 1) for i in range(12))


def test_line_dedup_edges(spark):
    assert line_dedup.deduped(messy(spark)).count() == messy(spark).count()
    assert line_dedup.deduped(empty(spark)).collect() == []


def test_pieces_are_those_of_sentencepiece():
    import sentencepiece

    sp, t = sentencepiece.SentencePieceProcessor(model_file=piece_transducer.default_model()), piece_transducer.transducer(piece_transducer.default_model())
    rng = random.Random(12)
    letters = "ab ▁\n\t<0x41>é́ﬁ你好😀ЖжאAtheon  ing.,"
    for text in ["", " ", "   lead", "tail   ", *(x for x in EDGE if x), *("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500))]:
        ids = t.encode(text)
        assert ids == sp.encode(text) and t.decode(ids) == sp.decode(ids), text


def test_tropical_shortest_path_of_a_unigram_model():
    rng = random.Random(18)
    pieces = [(p, -rng.uniform(1, 12)) for p in ["a", "b", "c", "ab", "bc", "abc", "ca", "aa", "▁", "▁a", "▁ab", "bb", "cab", "bca"]]
    t = piece_transducer.Transducer([*[("", 0.0)] * 256, *pieces], 0, bpe=False)
    score = dict(pieces)

    def brute(text):
        if not text:
            return 0.0
        ways = [-score[text[:k]] + brute(text[k:]) for k in range(1, min(4, len(text)) + 1) if text[:k] in score]
        return min([*ways, *([t.fallback + brute(text[1:])] if text[0] not in score else [])])

    for _ in range(300):
        text = "".join(rng.choice("abc é") for _ in range(rng.randrange(12)))
        path = t.shortest(t.normalised(text))
        assert "".join(path) == t.normalised(text)
        assert sum(-score[p] if p in score else t.fallback for p in path) == pytest.approx(brute(t.normalised(text)))
        assert t.decode(t.encode(text)) == text


def test_pieces_of_long_texts_without_spaces_take_linear_time():
    t = piece_transducer.transducer(piece_transducer.default_model())
    text = "".join(random.Random(19).choice("abcdefghij") for _ in range(200_000))
    began = time.perf_counter()
    assert t.decode(t.encode(text)) == text
    assert time.perf_counter() - began < 5
    assert t.known_bytes <= piece_transducer.KNOWN_BYTES


def test_models_of_other_kinds_are_refused():
    with pytest.raises(ValueError, match="space"):
        piece_transducer.Transducer([*[("", 0.0)] * 256, ("a▁b", -1.0)], 0)
    with pytest.raises(ValueError, match="each character"):
        piece_transducer.Transducer([*[("", 0.0)] * 256, ("ab", -1.0), ("a", -2.0)], 0)


def test_piece_columns(spark):
    df = messy(spark).select("doc_id", "text", piece_transducer.encoder()("text").alias("ids")).withColumn("back", piece_transducer.decoder()("ids"))
    for r in df.collect():
        assert r.back == (r.text or "")
    assert empty(spark).select(piece_transducer.encoder()("text")).collect() == []


def test_every_letter_has_a_language(spark):
    docs = table(spark, ["the cat and the dog", "der Hund und die Katze"] * 10, langs=["en", "de"] * 10)
    odd = ["ދިވެހި", "ܣܘܪܝܝܐ", "ߒߞߏ", "µ", "ª", "12 º", "𐍈", "ⴰⴱ", "Ꭰ", "١٢", "§ ©", "12 %", ""]
    got = [r.lang_pred for r in language_id.identified(table(spark, odd), language_id.train(docs)).orderBy("doc_id").collect()]
    assert got == ["en" if g == "en" else "de" if any(c.isalpha() for c in t) else "und" for g, t in zip(got, odd)]
    assert language_id.split("É é".encode()) == ["é".encode()] * 2


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(0, 300, rng.integers(1, 8))
        scores = rng.normal(0, 3, (lengths.sum(), 4))
        path, at = language_id.viterbi(scores, lengths, 5.0), 0
        for n in lengths:
            if n:
                s, p = scores[at : at + n], path[at : at + n]
                best = s[0].copy()
                for row in s[1:]:
                    best = np.maximum(best, best.max() - 5.0) + row
                assert s[np.arange(n), p].sum() - 5.0 * (np.diff(p) != 0).sum() == pytest.approx(best.max())
            at += n


def test_language_spans_and_edges(spark):
    en, de, ru = "the cat and the dog went with this thing", "der Hund und die Katze gingen nicht mit", "это просто русский текст для проверки языка"
    docs = table(spark, [en, de, ru] * 20, langs=["en", "de", "ru"] * 20)
    model = language_id.train(docs)
    mixed = language_id.identified(table(spark, [f"{en} {en} {de} {de} {de}", ru, None, "", "123 !?", "x" * 100000]), model).orderBy("doc_id").collect()
    assert [s.lang for s in mixed[0].spans] == ["en", "de"] and mixed[0].spans[0].stop == 18 and mixed[0].lang_pred == "de"
    assert mixed[1].lang_pred == "ru"
    assert [r.lang_pred for r in mixed[2:5]] == ["und"] * 3 and all(0 <= r.score <= 1 for r in mixed)
    assert language_id.identified(messy(spark), model).count() == messy(spark).count()
    assert {r.lang_pred for r in language_id.identified(messy(spark), language_id.train(empty(spark))).collect()} == {"und"}
    assert language_id.identified(empty(spark), model).collect() == []


def labels(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, label int").withColumn("text", F.lit("clash"))


def test_quality_classifier(spark):
    rng = random.Random(13)
    good = [" ".join(f"word{rng.randrange(500)}" for _ in range(60)) + "." for _ in range(80)]
    bad = [" ".join(f"WORD{rng.randrange(9)}!!" for _ in range(60)) for _ in range(40)]
    docs = table(spark, good + bad + EDGE[:5])
    model = quality_classifier.fit(docs, labels(spark, [(i, int(i < 80)) for i in range(0, 120, 2)] + [(None, 1), (1, None)]))
    got = {r.doc_id: r for r in quality_classifier.scored(docs, model).collect()}
    assert all(got[i].predicted == int(i < 80) for i in range(1, 120, 2))
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 125
    assert quality_classifier.accepted(docs, model).columns == docs.columns
    blank = quality_classifier.fit(docs, labels(spark, []))
    assert {r.score for r in quality_classifier.scored(messy(spark), blank).collect()} == {0.5}
    assert quality_classifier.scored(empty(spark), model).collect() == []


def test_pair_gradient_of_the_quality_classifier():
    """Weights end where the gradient of the pairs' logistic loss, taken over all pairs by differences, is about 0."""
    rng = np.random.default_rng(25)
    n = quality_classifier.N_FEATURES
    label = (np.arange(300) % 3 > 0).astype(int)
    x = rng.normal(0, 1, (300, n)) + 0.5 * label[:, None] * (np.arange(n) < 3)
    model = quality_classifier.fit_arrays(x, label)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    apart = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, n)
    loss = lambda w: np.log1p(np.exp(-apart @ w)).mean() + 5e-4 * w @ w
    slopes = [(loss(model.weights + 1e-4 * e) - loss(model.weights - 1e-4 * e)) / 2e-4 for e in np.eye(n)]
    assert np.abs(slopes).max() < 0.02 and loss(model.weights) < 0.8 * loss(np.zeros(n))
    s = z @ model.weights  # the threshold is a quantile that parts the labels as well as any
    right = lambda c: (s[label == 1] >= c).mean() + (s[label == 0] < c).mean()
    assert right(model.threshold) >= max(map(right, np.quantile(s, np.linspace(0, 1, 401)))) - 0.02


def test_features_of_quality_by_hand():
    text = "Aa bb bb\ncc!\ncc!"
    f = dict(enumerate(quality_classifier.features(text.encode())))
    k = len(quality_classifier._groups) + 2
    words, pairs = ["Aa", "bb", "bb", "cc!", "cc!"], 4
    assert f[0] == pytest.approx((1 / 16) ** 0.5) and f[3] == pytest.approx((2 / 16) ** 0.5)
    assert f[k] == pytest.approx(np.log1p(5) / 5) and f[k + 1] == pytest.approx(16 / 5 / 10) and f[k + 2] == pytest.approx(3 / 5**0.9)
    assert f[k + 3] == pytest.approx((2 / 5) ** 0.5) and f[k + 4] == pytest.approx((2 / 5) ** 0.5)
    assert f[k + 5] == pytest.approx((1 - len(set(zip(words, words[1:]))) / pairs) ** 0.5) and f[k + 6] == pytest.approx((1 / 3) ** 0.5)
    assert not quality_classifier.features(b" \n").any()


def small_network(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, 50, n).astype(np.int32) for n in (0, 1, 2, 3, 9, 40)]
    model = toxicity._start(texts, np.array([0, 1, 0, 1, 0, 1.0]), rng)
    model.embedding = rng.normal(0, 1, model.embedding.shape).astype(np.float32)
    model.embedding[toxicity.PAD] = 0
    return texts, model


def test_convolution_by_brute_force():
    texts, model = small_network(26)
    top, _ = model.pooled(texts)
    for t, row in zip(texts, top):
        padded = np.concatenate([np.zeros((2, toxicity.DIM)), model.embedding[t], np.zeros((2, toxicity.DIM))])
        for j, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                values = [sum(padded[i + k] @ model.filters[w][k][:, f] for k in range(w)) + model.bias[w][f] for i in range(len(t) + 2)]
                assert row[j * toxicity.FILTERS + f] == pytest.approx(max(0, *values), abs=1e-4)


def test_best_cut_errs_least():
    rng = np.random.default_rng(27)
    for _ in range(50):
        z, y = rng.normal(0, 1, 30), rng.integers(0, 2, 30)
        wrong = lambda c: ((z >= c) != y).sum()
        assert wrong(toxicity.best_cut(z, y)) == min(map(wrong, [*z, z.max() + 1]))


def test_toxicity(spark):
    rng = random.Random(14)
    plain = [" ".join(f"word{rng.choice('abcdefghij')}{rng.choice('klmnop')}" for _ in range(40)) for _ in range(300)]
    texts = [t.replace("worda", "nasty", 2) + " vile" if i % 3 == 0 else t for i, t in enumerate(plain)] + EDGE[:6]
    docs = table(spark, texts)
    model = toxicity.fit(docs, labels(spark, [(i, int(i % 3 == 0)) for i in range(300) if i % 5]))
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert np.mean([got[i].predicted == int(i % 3 == 0) for i in range(0, 300, 5)]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in toxicity.scored(messy(spark), toxicity.fit(docs, labels(spark, []))).collect()} == {0.0}
    assert toxicity.scored(empty(spark), model).collect() == []
