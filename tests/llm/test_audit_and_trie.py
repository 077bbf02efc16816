"""Filter audit and prefix trie against brute force, and with edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, prefix_trie, quality_rules

from .test_operators import CLASHES, empty, messy, table


def brute_mask(text, doc_id, smallest):
    w = text.encode().split()
    bits = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text), doc_id is not None and smallest is not None and doc_id > smallest]
    return sum(1 << i for i, b in enumerate(bits) if b)


def brute_audit(rows, labels):
    """rows: (doc_id, text, lang)."""
    least, good, toxic = {}, {}, {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        good[i], toxic[i] = good.get(i, 0) | (q == 1), toxic.get(i, 0) | (x == 1)
    out = {}
    for part in {lang or "" for *_, lang in rows}:
        own = [(brute_mask(t or "", i, least.get(t or "")), good.get(i, 0), toxic.get(i, 0)) for i, t, lang in rows if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [m for m in left if m[0] & bit]
                left = [m for m in left if not m[0] & bit]
                shapley[f] += len(gone)
                fails = sum(bool(m[0] & bit) for m in own)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(m[0] == bit for m in own), sum(m[1] for m in gone), sum(m[2] for m in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(map(int, v)) for k, v in out.items()}


def got_audit(docs, labels):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(docs, labels).collect()}


def audit_texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "CD", "ef#", "gh", "i|", "é", "lm", "x", "YZ", "Long", *(f"w{i}" for i in range(400))])
    texts = [" ".join(word() for _ in range(rng.choice([3, 99, 100, 101, 130, 300]))) for _ in range(60)]
    texts += ["".join(rng.choice("aB \n\t|") for _ in range(40)) for _ in range(20)]
    return texts + [rng.choice(texts) for _ in range(80)] + ["", None]


@pytest.mark.parametrize("at_once", [1 << 28, 512])
def test_audit_equals_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(filter_audit, "MAX_BYTES", at_once)  # 512: a section for each block
    monkeypatch.setattr(filter_audit, "HELD", 30)
    texts = audit_texts(3)
    if at_once == 512:
        monkeypatch.setattr(filter_audit, "blocks_for", lambda n: 4)
    langs = [["en", "de", "", None][i % 4] for i in range(len(texts))]
    docs = table(spark, texts, langs=langs).repartition(5)
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, len(texts), 2)] + [(0, None, None), (4, 1, None), (4, 0, 1), (None, 1, 1), (10**9, 1, 1)]
    shown = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert got_audit(docs, shown) == brute_audit([(i, t, langs[i]) for i, t in enumerate(texts)], labels)


def test_audit_edges(spark):
    docs = messy(spark)
    labels = spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int").withColumns({c: F.lit("clash") for c in CLASHES if c != "label"})
    assert got_audit(docs, labels) == brute_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(3, 1, 1)])
    assert filter_audit.audit(empty(spark), labels).count() == 0
    long = table(spark, ["word " * 400_000, "word " * 400_000])
    assert got_audit(long, labels)["en", "ABCDE", 5][:2] == (0, 0)


def test_sketch_never_clears_a_repeat(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, 3000)
    h = np.concatenate([h, h[:300], h[:5]])
    hashes = spark.createDataFrame([(int(x),) for x in h], "h long").repartition(7)
    blocks = filter_audit.blocks_for(len(h))
    found = filter_audit.with_possible(hashes, filter_audit.counted(hashes, blocks), blocks).collect()
    again = set(h[:300].tolist())
    assert len(found) == len(h) and all(r.possible for r in found if r.h in again)
    assert sum(r.possible for r in found if r.h not in again) < 0.1 * 2700


def brute_trie(rebuilt):
    """rebuilt: {conv_id: [(role, text)]}."""
    members, children = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        kids = children.get(node, [])
        leaves, saved = 0 if kids else 1, (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for k in kids:
            more = below(k)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(rebuilt[c]) == len(node))))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])), *below(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuild(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def got_trie(messages):
    found = prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.sequences(messages)))
    assert found.columns == [c.split()[0] for c in prefix_trie.NODE.split(", ")]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("batch", [1, 7, 20_000])
def test_trie_equals_brute_force(spark, monkeypatch, batch):
    monkeypatch.setattr(prefix_trie, "BATCH", batch)
    rng, rows = random.Random(batch), []
    for c in rng.sample(range(-30, 250), 200):
        same = rng.random() < 0.3  # a third says the same
        for turn in range(3 if same else rng.choice([1, 2, 4, 8, 12])):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", "common" if same else rng.choice(["hello", "été", "", None, "x" * 50, f"turn {rng.randrange(3)}"])))
    rows += [(5, None, "system", "first"), (5, None, "system", "first"), (5, 0, None, None), (None, 0, "user", "lost"), (7, 3, "user", "a"), (7, 3, "user", "b")]
    rows += [(400, i, "user", f"long {i}") for i in range(300)] + [(401, i, "user", f"long {i}") for i in range(250)]
    rng.shuffle(rows)
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)
    assert got_trie(messages) == brute_trie(rebuild(rows))


def test_trie_of_wide_branches_and_nothing(spark):
    rows = [(i, 0, "user", f"text {i % 300}") for i in range(600)] + [(i, 1, "user", "same") for i in range(600)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got_trie(messages) == brute_trie(rebuild(rows))
    assert got_trie(messages.limit(0)) == []


def test_layouts_grow():
    tree, keys = prefix_trie.Tree(), []
    rng = random.Random(2)
    for n in (4, 5, 16, 17, 48, 49, 256):
        tree, keys = prefix_trie.Tree(), [bytes([b, 7]) for b in rng.sample(range(256), n)]
        for i, k in enumerate(keys):
            tree.insert(k, [1], i)
        kind = prefix_trie.Few if n <= 16 else prefix_trie.Indexed if n <= 48 else prefix_trie.Direct
        assert isinstance(tree.root.kids, kind) and (kind is not prefix_trie.Few or tree.root.kids.most == (4 if n <= 4 else 16))
        assert [k.path for k in tree.root.kids.ordered()] == sorted(keys)


def test_only_whole_turns_become_nodes():
    tree = prefix_trie.Tree()
    for i, k in enumerate([b"aaaabbbb", b"aaaabbcc", b"aaaabbccdddd", b"aabb"]):
        tree.insert(k, [1] * (len(k) // 4), i)
    rows, beside = prefix_trie.nodes_of(tree, b"aaaabbbb", b"aabb", width=4)
    assert sorted((r[0], r[1], r[3], r[4], r[5]) for r in rows) == [(1, 2, 2, 1, 1), (2, 3, 1, 0, 1)]
    assert sorted(beside[0]) == [0, 4, 8] and sorted(beside[1]) == [4]
    assert beside[0][4][0].tops == 1 and beside[0][0][0].n == 0 and beside[1][4][0].n == 1

JUNK = ("marks", "capitals", "long_words", "dup_lines", "repeats")


def test_every_quality_rule_rejects_junk_of_each_language(spark):
    rng = random.Random(9)
    rows, junk = [], {}
    for lang in ("en", "de", "fr", "es"):
        word = lambda n=5, lang=lang: lang[0] + "".join(rng.choice("abcdefghij") for _ in range(n + rng.choice((-1, 0, 1))))
        for i in range(400):
            lines = [" ".join(word() for _ in range(10)) + "." for _ in range(8)]
            if i % 40 == 1:
                lines.append(lines[0][:20])
            kind = JUNK[i % 5] if i >= 395 else None
            if kind == "marks":
                lines = [x.replace(" ", " #!? ") for x in lines]
            elif kind == "capitals":
                lines = [x.upper() for x in lines]
            elif kind == "long_words":
                lines = [" ".join(word(18) for _ in range(10)) for _ in range(8)]
            elif kind == "dup_lines":
                lines = [y for x in lines for y in (x, "so it is", word())]
            elif kind == "repeats":
                lines.append(" ".join(lines[2].split()[:8]))
            if kind:
                junk[len(rows)] = (lang, kind)
            rows.append((len(rows), "\n".join(lines), lang, f"s{i % 3}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    assert not any(found[i].base_failed for i in junk), [junk[i] for i in junk if found[i].base_failed]
    assert [junk[i] for i in junk if found[i].kept] == []
    clean = [r.kept for i, r in found.items() if i not in junk]
    assert sum(clean) >= 0.98 * len(clean)
    limits = {r: max(x.fences[r] for x in quality_rules.thresholds(quality_rules.base_stats(docs)).collect()) for r in JUNK}
    assert limits["repeats"] < 200 and limits["dup_lines"] < 500
