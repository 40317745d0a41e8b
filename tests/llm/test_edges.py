"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carbonsplit.sources import written_tables
from carbonsplit.llm import chat, common, decontamination, html_text, line_dedup, mixing, quality, secrets, simhash, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash long, size string, label int, copy string"
LONG = "word " * 20_000


def docs(spark, rows):
    """Documents with columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, None, s, None, 7, "x", 1, "c") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, [(1, None, "a"), (2, "", None), (3, "One two three\nfour", "b"), (3, "One two three\nfour", "b"), (None, "one TWO three", "a"), (4, LONG, "a"), (5, " \n\t", "c")])


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_line_dedup(odd, none):
    found = {(r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(odd).collect()}
    # the null id comes first, so its line stays and those of document 3 go
    assert found == {(1, 0, 0, None), (2, 1, 0, ""), (3, 2, 1, "four"), (None, 1, 0, "one TWO three"), (4, 1, 0, LONG), (5, 2, 0, " \n\t")}
    assert line_dedup.dedup_lines(odd).count() == odd.count()
    assert rows(line_dedup.dedup_lines(none)) == []


def test_line_dedup_without_broadcast(spark, monkeypatch):
    """A table whose arrays hold more values than may be broadcast is joined by shuffle, with the same rows."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    gone = spark.createDataFrame([(1, [1, 2, 3])], "doc_id long, removed array<int>")
    explained = [small._jdf.queryExecution().analyzed().toString() for small in (common.small(gone), common.small(gone, F.size("removed")))]
    assert ["broadcast" in plan for plan in explained] == [True, False]
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, [(1, "a b c\nd e f\na b c\nf e d", "s"), (2, "x y z\na b c", "s")])).collect()}
    assert found == {1: "a b c\nd e f", 2: "x y z"}


def test_line_dedup_takes_text_ids(spark):
    """Order is that of the ids' own type: 10 comes before 9 as text."""
    lines = [("9", "a b c d e f g h i j"), ("10", "a b c d e f g h i k"), ("a1", "x y z"), ("b2", "z y x")]
    found = line_dedup.dedup_lines(spark.createDataFrame(lines, "doc_id string, text string"))
    assert {(r.doc_id, r.n_removed) for r in found.collect()} == {("9", 1), ("10", 0), ("a1", 0), ("b2", 1)}


def test_tables_passed_on_the_way_are_removed(spark):
    before = set(written_tables(spark))
    docs_ = spark.createDataFrame([(1, "a b c\na b c"), (2, "c b a")], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.dedup_lines(docs_).collect()) == ["", "a b c"]
    assert len(set(written_tables(spark)) - before) == 1


def test_line_dedup_brute_force(spark):
    choose = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    lines = []
    for _ in range(60):
        base = choose.sample(words, choose.randint(1, 30))
        lines += [base] + [[w for w in base if choose.random() > 0.08] + choose.sample(words, choose.randint(0, 2)) for _ in range(4)]
    choose.shuffle(lines)
    texts = [(n, "\n".join(" ".join(x) for x in lines[5 * n : 5 * n + 5]), "s") for n in range(60)]
    earlier, want = [], {}
    for n, text, _ in texts:
        kept = []
        for line in text.split("\n"):
            own = set(line.split())
            if not own or not any(len(own & e) * 180 >= (len(own) + len(e)) * 80 for e in earlier):
                kept.append(line)
            earlier += [own] if own else []
        want[n] = "\n".join(kept)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts)).collect()} == want


def test_simhash(odd, none, spark):
    found = simhash.near_duplicates(odd).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 7 and by_id[1].fingerprint == "0" * 16
    assert {by_id[i].component_id for i in (1, 2, 5)} == {1}
    assert rows(simhash.near_duplicates(none)) == []
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4]


def test_ball_links_reach_all(spark):
    choose = random.Random(1)
    values = set()
    for _ in range(20):
        at = choose.getrandbits(64)
        for _ in range(5):
            values.add(at)
            for _ in range(choose.randint(1, 3)):
                at ^= 1 << choose.randrange(64)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    group = {v: v for v in signed}
    for _ in signed:
        for a, b in itertools.combinations(signed, 2):
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                group[a] = group[b] = min(group[a], group[b])
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    labels = dict(rows(simhash.components(simhash.links(frame, 2))))
    assert {v: labels.get(v, v) for v in signed} == group


def test_decontamination(odd, none, spark):
    items = spark.createDataFrame([(1, "One, two THREE"), (1, "four"), (None, "word word"), (2, None), (3, "...")], "item_id long, text string")
    found = {r.doc_id: r for r in decontamination.contaminated_words(odd, items).collect()}
    assert (found[3].n_words, found[3].n_hit, found[3].items) == (4, 4, ["1"])
    assert [(s.start, s.end) for s in found[3].spans] == [(0, 18)]
    assert found[4].n_hit == 20_000 and found[4].items == [""] and found[1].n_words == 0
    split = {r.doc_id: r.n_hit for r in decontamination.contaminated_words(odd, items, block_bytes=4).collect()}
    assert split == {i: r.n_hit for i, r in found.items()}
    assert rows(decontamination.contaminated_words(none, items)) == []
    assert all(r.n_hit == 0 for r in decontamination.contaminated_words(odd, items.limit(0)).collect())


def test_mixing(odd, none, spark):
    assert rows(mixing.mix(none)) == [] and rows(mixing.mixed_documents(none)) == []
    found = mixing.mix(odd).collect()
    assert len(found) == 7 and all(r.taken <= 2 * r.size for r in found)
    assert mixing.mixed_documents(odd).columns == [c for c in odd.columns if c != "copy"] + ["copy"]
    many = docs(spark, [(n, "w " * (1 + n % 7), f"s{n % 3}") for n in range(600)])
    sums = mixing.mix(many).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert all(abs(r.t - r.n) <= 7 for r in sums)
    assert sorted(rows(mixing.mix(many))) == sorted(rows(mixing.mix(many.repartition(5))))


def test_secrets(odd, none, spark):
    assert rows(secrets.secrets(none)) == []
    assert all(r.spans == [] for r in secrets.secrets(odd).collect())
    text = "\x01é password=aaaaaaaa secret: token = abcdefghij " + "0f" * 16
    found = secrets.secrets(docs(spark, [(1, text, "a"), (1, text, "a")])).collect()
    assert [[(s.name, s.start, s.end) for s in r.spans] for r in found] == [[("assign", 3, 20), ("hex", text.index("0f0f"), len(text))]] * 2
    assert secrets.trigram_query(r"[0-9a-f]{32,}") is None and secrets.trigram_query("ab?cd") == {frozenset({"abc", "bcd"}), frozenset({"acd"})}


LABELS = "doc_id long, quality int, toxic int"


def labelled_rows(spark, n=240):
    choose = random.Random(5)
    plain = [f"word{i}" for i in range(80)]
    out, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = choose.choices(plain, k=30)
        if bad:
            words[choose.randrange(30)] = "vile"
            words[choose.randrange(30)] = "vileness"
        out.append((i, " ".join(words), "s"))
        marks.append((i, int(not bad), int(bad)))
    return docs(spark, out), spark.createDataFrame([*marks, (None, 1, 1), (3, None, None)], LABELS)


def test_toxicity(odd, none, spark):
    texts, labels = labelled_rows(spark)
    found = toxicity.toxicity(texts, labels).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in found)
    text = {r.doc_id: r.text for r in texts.collect()}
    assert {text[r.doc_id][s.start : s.end] for r in found for s in r.spans} == {"vile", "vileness"}
    assert toxicity.toxicity(odd, labels).count() == 7 and rows(toxicity.toxicity(none, labels)) == []
    assert all(r.score <= 0.5 for r in toxicity.toxicity(odd, labels.limit(0)).collect())


def test_chain_marginals_by_enumeration():
    random_state = np.random.default_rng(0)
    emit, moves = random_state.normal(size=6), random_state.normal(size=(2, 2))
    left, right = toxicity.Chains(np.array([4, 2])).messages(emit, moves)
    for start, n in ((0, 4), (4, 2)):
        weight = np.zeros((n, 2))
        for tags in itertools.product((0, 1), repeat=n):
            score = np.exp(sum(emit[start + i] * t for i, t in enumerate(tags)) + sum(moves[a, b] for a, b in itertools.pairwise(tags)))
            for i, t in enumerate(tags):
                weight[i, t] += score
        assert np.allclose((left + right)[start : start + n], np.log(weight[:, 1] / weight[:, 0]))


def test_quality(odd, none, spark):
    texts, labels = labelled_rows(spark)
    found = quality.quality(texts, labels).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 != 0) for r in found]) > 0.9
    assert quality.quality(odd, labels).count() == 7 and rows(quality.quality(none, labels)) == []
    assert {r.score for r in quality.quality(odd, labels.limit(0)).collect()} == {0.5}


PAGE = "<body><nav><a href=/>Home</a></nav><article><h1>T &amp; x</h1><p>Some  <b>bold</b>\ntext<p>more</article><footer>f</footer>"


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 1), (None, "v", "", 1), (4, "w", "<p>" * 3000, 1)], "page_id long, url string, html string, text int")
    found = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert found == {1: "T & x\nSome bold text\nmore", 2: "", None: "", 4: ""}
    assert rows(html_text.main_text(pages.limit(0))) == []


def test_tree_marginals_by_enumeration():
    page = html_text.parsed("<div><p>a<b>c</b></p><nav>d</nav></div>")
    random_state = np.random.default_rng(0)
    unary, edges = random_state.normal(size=len(page.nodes)).tolist(), random_state.normal(size=(3, 2, 2))
    weight = np.zeros((len(unary), 2))
    for states in itertools.product((0, 1), repeat=len(unary)):
        score = sum(u * s for u, s in zip(unary, states, strict=True))
        score += sum(edges[html_text._kind(n)][states[n.parent]][states[i]] for i, n in enumerate(page.nodes) if i)
        for i, s in enumerate(states):
            weight[i, s] += np.exp(score)
    assert np.allclose(html_text.messages(page, unary, edges)[0], np.log(weight[:, 1] / weight[:, 0]))


def test_topk_brute_force(spark):
    random_state = np.random.default_rng(2)
    vectors = [(i, random_state.normal(size=8).tolist()) for i in range(700)] + [(800 + i, [0.5] * 8) for i in range(30)]
    odd_rows = [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (None, [0.1] * 8), (1000, [1.0, 2.0]), (1100, [2.0, 1.0])]
    frame = spark.createDataFrame([*vectors, *odd_rows, vectors[100]], "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    whole = {i: np.floor(np.array(v) * 1024).astype(int) for i, v in [*vectors, *odd_rows[-2:]]}
    want = set()
    for q in [i for i in whole if i % 100 == 0]:
        scored = [(-int(whole[q] @ v), i) for i, v in [*whole.items(), (100, whole[100])] if i != q and len(v) == len(whole[q])]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:10])}
    assert set(rows(topk.top_k(frame, F.col("vec_id") % 100 == 0))) == want
    assert rows(topk.top_k(frame.limit(0), F.col("vec_id") % 100 == 0)) == []


def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    turns = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 1, "assistant", "b"), (None, None, None, None), (2, 0, "assistant", "x" * 50_000), (2, 0, "assistant", "x" * 50_000)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(0))
    found = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert (found["1"].n_turns, found["1"].loss_chars) == (3, 2 * len(said) - len(said) + 1)
    assert found["1"].loss_sha256 == hashlib.sha256((said + "b").encode()).hexdigest()
    assert found["1"].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\nassistant\nb\n".encode()).hexdigest()
    assert found[None].n_turns == 1 and found["2"].loss_chars == 100_000
    assert rows(chat.format_conversations(frame.limit(0))) == []


def test_template_language():
    render = chat.compiled("{% for m in messages %}{% if not m.a == 'x' and 'p' + 'q' == 'pq' %}{{ m.a | upper }}{% elif m.b %}B{% else %}-{% endif %}{% endfor %}")
    made = chat.pieces(render, [{"a": "k"}, {"a": "x", "b": "1"}, {"a": "x"}])
    assert "".join(text for text, _, _ in made) == "KB-"
    assert chat.folded(chat.parse("a{{ 'b' + 'c' }}{% if 'x' == 'y' %}no{% else %}d{% endif %}")) == (chat.Text("abcd"),)
    for wrong in ("{{ m.a() }}", "{% import os %}", "{% if a %}", "{{ a | eval }}", "{{ __import__('os') }}"):
        with pytest.raises(chat.TemplateError):
            chat.compiled(wrong)
    text = "\\l<>\"#\\\\"
    assert chat.unescape(chat.escape(text)) == text
    cut = list(chat.pieces(chat.compiled(chat.TEMPLATE), [{"role": "user", "text": "abc"}] * 5, limit=1))
    assert [turns for _, _, turns in cut] == [1, 1, 1, 1, 1, 0]
