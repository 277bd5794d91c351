"""Operators over the whole corpus against brute force: op1, op2, op3, op7, op8 and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import corpus, empty, frame, low, words
from tests.oracle import assert_same, rows as as_rows
from tidewire.llm import fixity, mixing, phrase_automata, queries, reply_trees, rule_ensemble, simhash
from tidewire.llm._shared import Scratch
from tidewire.operators.graph import components


def _roots(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in linked:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_simhash(spark):
    rows = corpus(6) + [(200, "one two"), (201, "One  TWO")]
    out = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = []
    for _, t in rows:
        w = words(low(t))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = _roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in root}
    expected = Counter((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in out) == expected
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_ball_has_every_value_once(spark):
    values = spark.range(1).select(F.explode(simhash.ball(F.lit(5).cast("long"), 1)).alias("v")).collect()
    assert len(values) == len({r.v for r in values}) == 65


def test_one_of_each(spark):
    base = [" ".join(f"w{(i * 31 + j * j) % 997}" for j in range(120)) for i in range(5)]
    near = [t.replace(t.split()[60], "changed", 1) for t in base]
    rows = [*enumerate(base), *((10 + i, t) for i, t in enumerate(near)), (20, base[0]), (20, base[0]), (21, None), (22, ""), (None, base[1]), (30, "short text")]
    kept = simhash.one_of_each(frame(spark, rows))
    assert Counter(r.doc_id for r in kept.collect()) == Counter([0, 1, 2, 3, 4, 21, 30])
    assert kept.columns == frame(spark, rows).columns
    assert simhash.one_of_each(empty(spark)).count() == 0


def _similarity(x, y):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (low(x).split(), low(y).split()))
    return len(a & b) / len(a | b)


def _one_of_each_by_force(texts, similarity=0.8):
    root = _roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if _similarity(texts[i], texts[j]) >= similarity])
    return {i for i, r in enumerate(root) if i == r}


def _kept_ids(spark, texts):
    return {r.doc_id for r in simhash.one_of_each(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}


def _drawn(r, n):
    return [f"v{r.randrange(10**6)}" for _ in range(n)]


def test_one_of_each_behind_a_repeated_line(spark):
    r, line = random.Random(11), " ".join(f"l{i}" for i in range(11))
    firsts = [_drawn(r, 300) for _ in range(60)]
    seconds = [[*w[:150], "changed", *w[151:]] for w in firsts]
    texts = [" ".join(w) + f" {line}" * 60 for w in firsts + seconds]
    assert all(_similarity(texts[i], texts[60 + i]) > 0.9 for i in range(60))
    assert _kept_ids(spark, texts) == set(range(60))


def test_one_of_each_compares_those_that_leaders_reject(spark, monkeypatch):
    """One minimum a value: nearly every value has many unlike texts, chains of similar ones among them."""
    monkeypatch.setattr(simhash, "ROWS", 1)
    r = random.Random(12)
    common, texts = _drawn(r, 40), []
    for _ in range(30):
        w = common + _drawn(r, 60)
        for _ in range(r.randrange(1, 5)):
            texts.append(" ".join(w))
            at = r.randrange(40, 90)
            w = w[:at] + _drawn(r, 5) + w[at + 5 :]
    r.shuffle(texts)
    expected = _one_of_each_by_force(texts)
    assert 30 <= len(expected) < len(texts) and _kept_ids(spark, texts) == expected


def _edited(r, kind):
    """A text of 400 words and one that is 0.80 to 0.85 similar: longer by a passage, or with one replaced."""
    w, n = _drawn(r, 400), r.randrange(75, 98) if kind == "append" else r.randrange(30, 40)
    at = r.randrange(1, 400 - n)
    other = w + _drawn(r, n) if kind == "append" else w[:at] + _drawn(r, n) + w[at + n :]
    return " ".join(w), " ".join(other)


def test_one_of_each_finds_contiguous_edits(spark):
    r = random.Random(13)
    pairs = [_edited(r, kind) for kind in ("append", "block") for _ in range(100)]
    assert all(0.8 <= _similarity(*p) <= 0.86 for p in pairs)
    assert _kept_ids(spark, [a for a, _ in pairs] + [b for _, b in pairs]) == set(range(200))


def test_one_of_each_counts_a_repeated_line_once(spark):
    r, texts = random.Random(14), []
    for _ in range(20):
        w, line = _drawn(r, 300), " ".join(_drawn(r, 10))
        texts.append((" ".join(w) + f" {line}", " ".join(w) + f" {line}" * 200))
    assert all(_similarity(*p) > 0.95 for p in texts)
    assert _kept_ids(spark, [a for a, _ in texts] + [b for _, b in texts]) == set(range(20))


def test_one_of_each_in_a_crowd(spark, monkeypatch):
    """One text edited many times over, with edits that coincide: bounds must leave no similar pair out."""
    r = random.Random(15)
    base, texts = _drawn(r, 120), []
    for _ in range(90):
        w = list(base)
        for _ in range(r.randrange(8)):
            w[r.randrange(0, 120, 6)] = r.choice("xyz")
        texts.append(" ".join(w[: r.randrange(90, 121)]))
    texts = sorted(set(texts), key=lambda t: r.random())
    expected = _one_of_each_by_force(texts)
    assert 10 < len(expected) < len(texts) - 20
    for crowd, few in ((3, 1), (3, 4), (64, 8)):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        monkeypatch.setattr(simhash, "FEW", few)
        assert _kept_ids(spark, texts) == expected


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(500, 501), (7, 7)], "a long, b long")
    out = {r.a: r.b for r in components(links).collect()}
    assert out == {**{i: 0 for i in range(1, 301)}, 501: 500}


def _kept(rows):
    seen = Counter(tuple(w[i : i + 35]) for w in (words(t) for _, t in rows) for i in range(len(w) - 34))
    out = []
    for i, t in rows:
        w = words(t)
        drop = {k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        out.append((i, len(w), len(drop), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in drop).encode()).hexdigest()))
    return out


def test_repeats(spark, monkeypatch):
    rows = corpus(7) + [(300, " ".join(["again"] * 50)), (301, " ".join(f"q{i}" for i in range(40)) + " x " + " ".join(f"q{i}" for i in range(40)))]
    expected = Counter(_kept(rows))
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    docs = frame(spark, rows)
    assert Counter(tuple(r[c] for c in columns) for r in phrase_automata.digests(docs).collect()) == expected
    for name, value in (("HOT", 2), ("SHARD", 3), ("TOGETHER", 2)):
        monkeypatch.setattr(phrase_automata, name, value)
    assert Counter(tuple(r[c] for c in columns) for r in phrase_automata.digests(docs).collect()) == expected
    assert phrase_automata.digests(empty(spark)).count() == 0
    cleaned = {r.doc_id: r.text for r in phrase_automata.without_repeats(docs).collect()}
    assert all(hashlib.sha256(" ".join(words(cleaned[i])).encode()).hexdigest() == h for i, _, _, h in expected)


def _around_one_phrase(n):
    """Pairs of texts with equal surroundings, other ones for each pair, of one common phrase."""
    r = random.Random(16)
    phrase = " ".join(_drawn(r, 18))
    return [(2 * i + j, f"{a} {phrase} {b}") for i in range(n) for a, b in [(" ".join(_drawn(r, 30)), " ".join(_drawn(r, 30)))] for j in (0, 1)]


def test_repeats_around_a_hot_phrase_grow_with_the_input(spark, monkeypatch):
    """Windows that all elect one anchor: what is sent to shards doubles with the texts, and the result is whole."""
    monkeypatch.setattr(phrase_automata, "HOT", 16)
    monkeypatch.setattr(phrase_automata, "SHARD", 64)
    sent = []
    for n in (50, 100, 200):
        rows = _around_one_phrase(n)
        scratch = Scratch(spark)
        docs = spark.createDataFrame([(i, t, 0, 1, 1) for i, t in rows], "doc_id long, text string, key long, twin long, copies long")
        texts = docs.select("text", F.xxhash64("text").alias("key"), F.lit(0).cast("long").alias("twin"), F.lit(1).cast("long").alias("copies"), F.sequence(F.lit(0), F.lit(62)).alias("places"))
        windows = texts.mapInArrow(phrase_automata._windows(35, 16), "key long, twin long, copies long, start int, hash long, check int")
        cells = phrase_automata._routes(scratch.store(windows), scratch)
        pieces = cells.join(texts, ["key", "twin"]).mapInArrow(phrase_automata._pieces(35), "shard long, salt int, stretch boolean, key long, twin long, begin int, words string")
        sent.append(pieces.agg(F.sum(F.length("words"))).first()[0])
        scratch.clear()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in phrase_automata.digests(docs).collect()) == Counter(_kept(rows))
    assert sent[1] < 2.5 * sent[0] and sent[2] < 2.5 * sent[1]


def test_mixing(spark, sf_dir):
    rows = [(i, t) for i, t in corpus(8, 200)]
    docs = frame(spark, rows)
    out = mixing.allocate(docs).collect()
    size = {i: len(words(t)) for i, t in rows}
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    assert all(r.size == size[r.doc_id] and r.taken in (0, r.size, 2 * r.size, 3 * r.size) and r.target <= 3 * r.source_size for r in out)
    assert abs(sum({(r.source_size, r.target) for r in out} and {r.source_size: r.target for r in out}.values()) - sum(r.size for r in out)) < 1
    assert Counter(out) == Counter(mixing.allocate(docs).collect())  # reruns agree
    kept = mixing.allocate(docs, keep_columns=True)
    assert kept.columns[: len(docs.columns)] == docs.columns and kept.count() == len(rows)
    assert mixing.allocate(empty(spark)).count() == 0
    assert_same(queries.op1_mixing(spark, sf_dir), mixing.SQL, sf_dir)


def test_mixing_targets_stop_and_excess_is_reshared(spark):
    cells = spark.createDataFrame([("a", 100), ("b", 1), ("c", 1), (None, 10)], "source string, words long")
    t = {r.source: r.target for r in mixing.targets(cells).collect()}
    assert t["b"] == 3 and t["c"] == 3 and abs(sum(t.values()) - 112) < 1e-9 and t[None] == 30


def test_fixity(spark, sf_dir):
    records = [("f", 100 * i, f"body {i}") for i in range(3000)] + [("g", 0, None), (None, 5, "x"), ("f", 300, "twice")]
    ours = spark.createDataFrame(records, "file string, offset long, payload string")
    changed = [(f, o, "X" if (f, o) == ("f", 70000) else p) for f, o, p in records if (f, o) != ("f", 200000)] + [("h", 1, "new")]
    theirs = spark.createDataFrame([("g", 0, "") if x[0] == "g" else x for x in changed], "file string, offset long, payload string")
    found = {(r.file, r.offset, r.status) for r in fixity.audit(fixity.tree(ours), fixity.tree(theirs)).collect()}
    assert found == {("f", 70000, "changed"), ("f", 200000, "missing"), ("h", 1, "extra"), ("g", 0, "changed")}
    assert fixity.audit(fixity.tree(ours), fixity.tree(ours)).count() == 0
    assert_same(queries.op2_fixity(spark, sf_dir), queries.OP2_SQL, sf_dir)


def test_fixity_of_records_without_offset_and_empty_replicas(spark):
    kinds = "file string, offset long, payload string, hash int, at string, up int"

    def frame_of(rows):
        return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], kinds)

    rows = [("f", None, "x"), ("f", None, "same"), ("f", None, "same"), ("f", 3, "y"), (None, None, None), ("g", 7, "z" * 3_000_000), ("g", 7, "twice"), ("", 9, "unnamed")]
    other = [("f", None, "changed"), ("f", None, "same"), ("f", 3, "y"), (None, 9, "unnamed"), ("g", 7, "twice"), ("g", 7, "z" * 2_999_999 + "!")]

    def audit(a, b):
        return Counter(tuple(r) for r in fixity.audit(fixity.tree(frame_of(a)), fixity.tree(frame_of(b))).collect())

    # of two equal records one is lost; a changed record is one missing and one extra; null names the empty file
    assert audit(rows, other) == Counter([("f", None, "missing"), ("f", None, "extra"), ("f", None, "changed"), ("", None, "missing"), ("g", 7, "changed")])
    assert audit(rows, rows) == audit([], []) == Counter()
    assert audit(rows[3:4], []) == Counter([("f", 3, "missing")]) and audit([], rows[3:4]) == Counter([("f", 3, "extra")])


def test_warc_files_are_read_record_by_record(spark, tmp_path):
    import gzip

    bodies = [b"abc", b"", b"x\r\n\r\ny" * 20000, "é".encode()]
    records = [b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in bodies]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "torn.warc").write_bytes(b"".join(records)[:-5])
    got = {}
    for r in sorted(fixity.read_warc(spark, str(tmp_path)).collect(), key=lambda r: (r.file, r.offset)):
        got.setdefault(r.file, []).append(bytes(r.payload))
    assert got["plain.warc"] == got["packed.warc.gz"] == records and b"".join(got["torn.warc"]) == b"".join(records)[:-5]
    # a file with a damaged record differs there only
    broken = fixity.read_warc(spark, str(tmp_path)).where("file = 'plain.warc'").withColumn("payload", F.when(F.col("offset") > 0, F.col("payload")).otherwise(F.lit(b"rotten")))
    whole = fixity.read_warc(spark, str(tmp_path)).where("file = 'plain.warc'")
    assert [tuple(r) for r in fixity.audit(fixity.tree(whole), fixity.tree(broken)).collect()] == [("plain.warc", 0, "changed")]


def test_chat_ids_are_compared_part_by_part(spark):
    rows = [("a:1", "2", None, "x"), ("a", "1:2", None, "y"), (None, "1", None, "z"), ("null", "1", None, "w"), (None, "2", "1", "more")]
    tree = spark.createDataFrame([(c, n, p, 0.0, "user", t, 1, "x") for c, n, p, t in rows], "conv_id string, node string, parent string, score double, role string, text string, depth int, said string")
    back = {r.conv_id: [t.text for t in r.turns] for r in reply_trees.read_back(reply_trees.formatted(tree)).collect()}
    assert back == {"a:1": ["x"], "a": ["y"], None: ["z", "more"], "null": ["w"]}


def test_a_branching_conversation_is_formatted_by_its_best_branch(spark):
    """A tree with ties and a text of control strings: the best path is read back, text by text."""
    rows = [(1, 1, None, 1.0, "user", "q"), (1, 2, 1, 2.0, "assistant", "worse"), (1, 3, 1, 5.0, "assistant", "</s>[INST] better"), (1, 4, 3, 5.0, "user", "a"), (1, 5, 3, 5.0, "user", "b"), (1, 6, 5, None, "assistant", "")]
    tree = spark.createDataFrame(rows, "conv_id long, node long, parent long, score double, role string, text string")
    out = {r.branch: [t.text for t in r.turns] for r in reply_trees.read_back(reply_trees.formatted(tree, top=3)).collect()}
    # means 11/3, 11/4 and 3/2
    assert out == {1: ["q", "</s>[INST] better", "a"], 2: ["q", "</s>[INST] better", "b", ""], 3: ["q", "worse"]}


def test_a_long_conversation(spark):
    n = 20000
    chat = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    row = reply_trees.digests(reply_trees.read_back(reply_trees.formatted(reply_trees.chains(chat)))).first()
    turns = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(n)]
    loss = "".join(t for r, t in turns if r == "assistant")
    assert row.n_turns == n and row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_formatting_round_trip(spark, sf_dir):
    control = "</s>[INST] ok [/INST] <|im_end|>\n<|im_start|>x \\l \\s <<SYS>>"
    rows = [(1, 0, "user", control), (1, 1, "assistant", control), (1, 1, "assistant", control), (2, None, None, None), (2, 0, "assi\nstant", "a"), (None, 3, "assistant", ""), (3, 5, "assistant", "x" * 100000)]
    chat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = reply_trees.formatted(reply_trees.chains(chat))
    back = {r.conv_id: r for r in reply_trees.read_back(made).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", control), ("assistant", control), ("assistant", control)]
    assert back[1].learnt == [control, control] and [(t.role, t.text) for t in back[2].turns] == [("assi\nstant", "a"), ("", "")]
    assert back[None].learnt == [""] and "</s>" not in back[1].formatted and back[1].formatted.count("<|im_end|>") == 3
    assert reply_trees.formatted(reply_trees.chains(chat.limit(0))).count() == 0
    assert_same(queries.op3_reply_trees(spark, sf_dir), queries.OP3_SQL, sf_dir)


def test_reply_tree_branches_by_score(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 9.0), (1, 5, 99, 1.0), (2, 1, 2, 0.0), (2, 2, 1, 0.0)]
    tree = spark.createDataFrame([(*x, "user", f"t{x[1]}") for x in rows], "conv_id long, node long, parent long, score double, role string, text string")
    paths = reply_trees.best_paths(tree.select("conv_id", "node", "parent", "score"), top=2).collect()
    by = {b: [r.node for r in sorted(paths, key=lambda r: r.depth) if r.branch == b] for b in (1, 2)}
    assert by == {1: [1, 3, 4], 2: [1, 2]}  # means 10/3 and 5/2; a parent that does not exist makes a root of its own; a cycle has no root


def _kept_by_hand(rows, benchmark):
    """What near_duplicates and then benchmark keep of (doc_id, text) rows."""
    texts = {}
    for i, t in rows:
        texts[t or ""] = min(i, texts.get(t or "", i))
    of = sorted(texts)
    root = _roots(len(of), [(i, j) for i in range(len(of)) for j in range(i) if _near(of[i], of[j])])
    least = {}
    for t, k in zip(of, root):
        least[k] = min((texts[t], t), least.get(k, (texts[t], t)))
    token = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {tuple(w[j : j + 10]) for w in map(token, benchmark) for j in range(max(len(w) - 9, min(len(w), 1)))}

    def hit(t):
        w = token(t)
        return any(tuple(w[j : j + m]) in windows for m in {len(p) for p in windows} for j in range(len(w) - m + 1))

    return {i for i, _ in least.values()}, {i for i, t in least.values() if not hit(t)}


def _near(x, y):
    a, b = ({tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if (w := low(t).split()) else set() for t in (x, y))
    return len(a & b) >= 0.8 * len(a | b)


def test_pipeline_stages_one_by_one(spark, tmp_path):
    """Each stage against what it must do, on rows with nulls, empty and long texts, repeated rows, clashing and further columns."""
    import corpus_pipeline as p

    rows = corpus(9, 40) + [(500, "call me at a@b.cd or 10.0.0.1 now"), (501, "call me at a@b.cd or 10.0.0.1 now"), (502, "x " * 30000)]
    items = [(1, " ".join(words(rows[0][1])[:15])), (2, "word w1"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(len(t or "") > 40), 0) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark, rows)
    stage = dict(p.STAGES)
    good = stage["quality"](spark, docs, str(tmp_path))
    scores = {r.doc_id: r.score for r in rule_ensemble.scores(docs, rule_ensemble.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))).collect()}
    assert Counter(r.doc_id for r in good.collect()) == Counter(i for i, _ in rows if scores[i] >= 0.3)
    once, clean = _kept_by_hand(rows, [t for _, t in items])
    alone = stage["near_duplicates"](spark, docs, str(tmp_path))
    assert Counter(r.doc_id for r in alone.collect()) == Counter(once)
    left = stage["benchmark"](spark, alone, str(tmp_path))
    assert Counter(r.doc_id for r in left.collect()) == Counter(clean) and 0 < len(clean) < len(once)
    private = {r.doc_id: r.text for r in stage["personal_data"](spark, docs, str(tmp_path)).collect()}
    assert private[500] == "call me at <EMAIL> or <IP> now" and private[40] is None and private[1] == dict(rows)[1]
    mixed = stage["mixture"](spark, docs, str(tmp_path)).collect()
    assert all(r.copies > 0 and r.taken == r.copies * r._size == r.copies * len(words(r.text)) and r.size == "x" for r in mixed)
    assert {r.doc_id for r in mixed} <= {i for i, t in rows if words(t)}
    none = empty(spark)
    for name, f in p.STAGES:
        out = f(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "mixture" or out.columns == none.columns)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "benchmark", "personal_data", "mixture"]
    ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
    out = p.run(spark, sf_dir)
    # the same stages, each on what its predecessor kept, held in memory
    by_hand = docs
    for _, stage in p.STAGES:
        made = stage(spark, by_hand, sf_dir)
        by_hand = spark.createDataFrame(made.collect(), made.schema)
    assert Counter(out.collect()) == Counter(by_hand.collect())
    assert not Counter(r.doc_id for r in out.select("doc_id").collect()) - ids and out.count() > 0
    left = " ".join(r.text for r in out.select("text").collect())
    assert "@mail" not in left


def test_oracles_run_on_an_empty_table():
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    assert as_rows(c.execute(mixing.SQL).df()) == Counter() and isinstance(c.execute("SELECT 1").df(), pd.DataFrame)


def test_one_of_each_frees_its_rounds(spark, monkeypatch):
    import os

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    left = []
    monkeypatch.setattr(simhash, "release", lambda s: left.append(sorted(x for x in os.listdir(shared) if x.startswith("scratch-"))))
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (3, "another text of a few words only")]
    before = {x for x in os.listdir(shared) if x.startswith("scratch-")} if os.path.isdir(shared) else set()
    assert {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 3}
    assert left and all(len(set(x) - before) <= 3 for x in left)  # the computation's own, its stored documents, one round's members


def test_components_of_few_links_are_tied_at_once(spark, monkeypatch):
    import random

    from tidewire.operators import graph

    rng = random.Random(5)
    links = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1300)] + [(i + 4001, i + 4000) for i in range(200)] + [(9000, x) for x in range(9001, 9200)] + [(-5, -9), (None, 3)]
    root = {v: v for x in links for v in x if None not in x}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        if None not in (a, b):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    expected = {v: top(v) for v in root if top(v) != v}
    frame_ = spark.createDataFrame(links, "a long, b long")
    rounds = []
    star = graph._star
    monkeypatch.setattr(graph, "_star", lambda x: rounds.append(1) or star(x))
    assert {r.a: r.b for r in components(frame_).collect()} == expected and not rounds
    monkeypatch.setattr(graph, "MOST_AT_ONCE", 0)
    assert {r.a: r.b for r in components(frame_).collect()} == expected and rounds
    monkeypatch.setattr(graph, "MOST_AT_ONCE", len(expected) + 50)  # the last rounds only
    assert {r.a: r.b for r in components(frame_).collect()} == expected
    assert components(frame_.where("a < -99")).count() == 0
