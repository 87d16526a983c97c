"""The operators on small tables: brute force, round trips, held-out accuracy, odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import connect, rows_of
from tickertide.llm import ann, bpe, chat, lm, mixing, near_vectors, ngram_join, quality, toxicity, url_filter
from tickertide.llm.common import components
from tickertide.llm.queries import ORACLE, QUERIES, vocabulary_path

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="given tables absent")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, unit string, row int"
LONG = "alpha beta gamma delta " * 30_000


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    rows = [
        (None, None, None, None, None, None, None, None),
        (None, "one two three four five six", None, "b", 1, "x", "u", 1),
        (1, "", "en", "a", 0, "x", "u", 1),
        (2, "   \n", "en", "a", 4, "x", "u", 1),
        (3, "word", "en", "a", 4, "x", "u", 1),
        (4, "word", "en", None, 4, "x", "u", 1),
        (5, "you idiot, you are a stupid clown.", "en", "a", 4, "x", "u", 1),
        (5, "you idiot, you are a stupid clown.", "en", "a", 4, "x", "u", 1),
        (6, LONG, "en", "b", len(LONG), "x", "u", 1),
        (7, "é Σ ß İ \x1c a\u0301 <|endoftext|>don't 12", "fr", "é", 9, "x", "u", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def labels(spark):
    return spark.createDataFrame(
        [(5, 0, 1), (3, 1, 0), (6, 1, 0), (None, 1, 1), (99, None, None), (3, 1, 0)],
        "doc_id long, quality int, toxic int",
    )


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    cur = connect(DATA).execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_chat_odd_rows_and_probe(spark):
    text = "\\### Assistant: </turn> ok"
    rows = [
        (-7, 0, "user", text), (-7, 1, "assistant", text), (None, 0, None, None), (None, 0, "to:ol", "\\"),
        (3, None, "assistant", ""), (3, 1, "user", "</turn>\n### User: x" * 3), (3, 1, "user", "\\\\###"),
        (4, 1, "user", "A"), (4, 1, "user", "###"), (4, 1, "user", "\\"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(turns.withColumn("pos", F.lit(1)))).collect()}
    assert got[-7].valid and not got[3].valid and got[-7].loss_chars == len(text)
    assert got[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    for conv in got:
        mine = sorted((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.chat_digests(chat.format_chats(turns.limit(0))).count() == 0


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("b.c", "/x", "block"), ("b.c", "/x", "allow"),
             (None, "/", "block"), ("d", None, "block")]
    urls = [None, "", "net/", "x://A.NET/", "x://a.net", "x://example.net/en/1?q", "y://q.b.c/xy#z", "z://bb.c/x",
            "w://d", "w://e.d?x://net/", "x://a.net/", "x://" + "a." * 3000 + "net/"]
    table = spark.createDataFrame([(u, "kept", "old") for u in urls], "url string, host_ string, rule string")
    got = url_filter.url_verdicts(table, spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = {None: None, "": None, "net/": None, "x://A.NET/": "net/", "x://a.net": None, "x://a.net/": "net/",
            "x://example.net/en/1?q": "example.net/en/", "y://q.b.c/xy#z": "b.c/x", "z://bb.c/x": None, "w://d": "d",
            "w://e.d?x://net/": "d", urls[-1]: "net/"}
    rows = got.collect()
    assert {r.url: r.rule for r in rows} == want and len(rows) == len(urls)
    assert all(r.verdict == ("block" if r.rule and r.rule != "example.net/en/" else "allow") for r in rows)
    none = url_filter.url_verdicts(table, spark.createDataFrame([], "host string, path string, verdict string"))
    assert none.where("rule IS NOT NULL").count() == 0


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_odd_rows(spark, kind):
    docs = odd_docs(spark)
    for known in (labels(spark), labels(spark).limit(0)):
        if kind == "quality":
            score = quality.quality_score(quality.train_quality(docs, known, F.lit(True)))
        else:
            score = toxicity.toxicity_score(toxicity.train_toxicity(docs, known, F.lit(True)))
        got = docs.select("doc_id", score("text").alias("s")).collect()
        assert len(got) == docs.count() and all(0 <= r.s <= 1 for r in got)
    assert docs.limit(0).select(score("text")).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="given tables absent")
@pytest.mark.parametrize(("name", "label", "least"), [("op3_quality_classifier", "quality", 0.97), ("op8_toxicity", "toxic", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{folder}/labels.parquet")
    got = QUERIES[name](spark, folder).where("held_out").join(known, "doc_id")
    right, n = got.agg(F.sum((F.col("predicted") == F.col(label)).cast("int")), F.count("*")).first()
    assert right / n > least


def test_grammar_tells_clauses_apart():
    lexicon = toxicity.Lexicon({"idiot$": 5.0, "lowe": 4.0})

    def kinds(text):
        return [e for e, v in zip(toxicity.EVENTS, toxicity.clause_events(text, lexicon), strict=False) if v]

    assert kinds("an idiot.") == ["insult"]
    assert kinds("You are an IDIOT") == ["insult at a target"]
    assert kinds("not an idiot") == ["negated insult"]
    assert kinds('they said "idiot" again') == ["reported insult"]
    assert kinds("I will kill you") == [] and kinds("you, I will kill you") == ["threat at a target"]
    assert kinds("loweish idiots") == ["insult"] and kinds("") == []


def test_mix_shares_and_bounds(spark):
    docs = odd_docs(spark)
    more = spark.createDataFrame(
        [(100 + k, "w " * (k % 37), "en", f"s{k % 4}", k, "x", "u", 1) for k in range(400)], DOCS
    )
    docs = docs.union(more).select("*", F.lit(1).alias("block"), F.lit(2).alias("words"))
    got = mixing.mix_report(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in got)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target = Counter(), {}
    for r in got:
        if r.doc_id is not None:
            taken[source[r.doc_id]] += r.taken
            target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) < 2 for s in ("s0", "s1", "s2", "s3", "a"))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(docs).collect()), key=str)
    text = mixing.mixed_documents(docs)
    words = text.agg(F.sum(F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")))).first()[0]
    assert text.columns == docs.columns and abs(words - sum(r.taken for r in got)) == 0
    assert mixing.mix_report(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mix_targets_and_permutation():
    assert mixing.targets({"a": 10, "b": 1000, None: 100}) == {"a": 30.0, "b": 780.0, None: 300.0}
    for n in (1, 2, 3, 100, 1000):
        p = mixing.permuted(np.arange(n), n, 1, 2)
        assert sorted(p) == list(range(n)) and (mixing.permuted(p, n, 1, 2, True) == np.arange(n)).all()
    slots = [1000, 3, 0, 77]
    counts = [mixing.shard_counts(slots, k, 9) for k in range(9)]
    assert (sum(c for c, _ in counts) == slots).all()
    assert all((counts[k][1] == sum((c for c, _ in counts[:k]), np.zeros(4))).all() for k in range(9))


def exact_links(rows):
    out = {}
    for i, (a, la, va) in enumerate(rows):
        out[i] = {
            j for j, (b, lb, vb) in enumerate(rows)
            if i != j and ok(va) and ok(vb) and la is not None and la == lb and len(va) == len(vb)
            and float(np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb)) >= 0.98
        }
    return out


def ok(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_near_vectors_odd_rows_and_dense_group(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(k, 1, (base + rng.normal(size=16) * 0.03).tolist()) for k in range(60)]
    rows += [(100 + k, k % 3, rng.normal(size=16).tolist()) for k in range(90)]
    rows += [(200 + k, 2, rows[70][2]) for k in range(5)] + [(300, None, rows[0][2]), (301, 1, None), (302, 1, [])]
    rows += [(303, 1, [0.0] * 16), (304, 1, [float("nan")] * 16), (305, 1, [None] * 16), (306, 1, [1.0, 0.0])]
    rows += [(307, 1, [1.0, 0.01]), (308, 7, [1e-200] * 16), (309, 7, [1e300] * 16)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, id int, x string")
    got = {r.vec_id: r for r in near_vectors.near_vectors(df).collect()}
    scaled = [(i, lab, [x * 1e200 for x in v] if i == 308 else [x * 1e-300 for x in v] if i == 309 else v) for i, lab, v in rows]
    links = exact_links(scaled)
    assert len(got) == len(rows)
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min(rows[j][0] for j in seen)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[k]), low, low == i)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_nearest_ties_and_recall(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(1500)]
    rows += [(5000 + k, rows[3][1]) for k in range(40)] + [(20, rows[20][1]), (6000, None), (6020, [0.0] * 8), (6040, [1.0])]
    rows += [(6060, [float("inf")] * 8), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, part int, unit int")
    got = ann.nearest(df).orderBy("query_id", "rank").collect()
    good = {i: np.array(v) for i, v in rows if i is not None and ok(v) and len(v) == 8}
    hit = 0
    asked = [i for i in good if i % 20 == 0]
    for q in asked:
        mine = [r for r in got if r.query_id == q]
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert mine == sorted(mine, key=lambda r: (-r.score, r.vec_id))
        assert all(abs(r.score - good[q] @ good[r.vec_id]) < 1e-9 for r in mine)
        best = sorted((-(good[q] * v).sum(), i) for i, v in good.items() if i != q)[:20]
        hit += len({i for _, i in best} & {r.vec_id for r in mine})
    assert hit / (20 * len(asked)) >= 0.9 and {r.query_id for r in got} == set(asked)
    assert ann.nearest(df.limit(0)).count() == 0
    few = ann.nearest(df.where("vec_id in (0, 1, 2)")).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(0, 1), (0, 2)]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    docs = odd_docs(spark)
    # Between letters: the canonical order of marks in a row differs with the Unicode version.
    more = ["x".join(chr(c) for c in range(lo, lo + 400) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x3400, 400)]
    more += ["It's we'll I'D <|startoftext|><|endoftext|> x<|endoftext|>y A\u0301\u00a0B", "ΑΣ ΣΑ\u2028x"]
    docs = docs.unionByName(
        spark.createDataFrame([(1000 + k, t, None, None, None, None, None, None) for k, t in enumerate(more)], DOCS)
    ).withColumn("ids", F.lit("clash"))
    got = bpe.encode_texts(docs, vocabulary_path()).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    assert len(got) == docs.count() and set(got[0].asDict()) == {*docs.columns, "decoded"}
    for r in got:
        if r.doc_id is not None:
            want = library.encode(text[r.doc_id], add_special_tokens=False).ids
            assert np.frombuffer(r.ids, "<u4").tolist() == want, r.doc_id
            assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_texts(docs.limit(0), vocabulary_path()).count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w: (k, k + 1) for k, w in enumerate(["in", "inner", "inners", "winner", "winners", "é", "we"])}
    packed = bpe.packed(bpe.compile_lexicon(words))
    (tmp_path / "x.bin").write_bytes(packed)
    t = bpe.Transducer(str(tmp_path / "x.bin"))
    asked = [*words, "i", "winnersx", "x", "innes"]
    numbers = t.numbers(asked).tolist()
    assert [t.ids_of(n) if n >= 0 else None for n in numbers] == [words.get(w) for w in asked]
    # "inners" and "winners" share their tail.
    assert len(t.final) < len(set("".join(words))) + 6


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").encode().lower().decode())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_ngram_join_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    for k in range(80):
        words = list(base)
        for p in rng.integers(0, 120, k % 7):
            words[p] = f"z{k}{p}"
        rows.append((1000 + k, " ".join(words)))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node int, unit int")
    found = ngram_join.ngram_join(docs).collect()
    sets = [shingles(t) for _, t in rows]
    links = [
        {j for j, b in enumerate(sets) if j != i and a and b and len(a & b) / len(a | b) >= 0.8} for i, a in enumerate(sets)
    ]
    by = {(r.doc_id, r.n_links): r for r in found}
    assert sum(r.n_same for r in found) == len(rows)
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        assert by[(doc, len(links[i]))].class_id == min(ids, default=None)
    kept = ngram_join.one_per_class(docs)
    classes = {r.class_id for r in found if r.n_links}
    lone = sum(r.n_same for r in found if not r.n_links)
    assert kept.columns == docs.columns and kept.count() == len(classes) + lone
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0


def test_ngram_blocks(spark, monkeypatch):
    """A bucket of several blocks gives the links of one."""
    docs = spark.createDataFrame(
        [(k, " ".join(f"a{i if i != k else 999 + k}" for i in range(200))) for k in range(40)], "doc_id long, text string"
    )
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    got = ngram_join.ngram_join(docs).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 39)}


def test_lm_counts_and_odd_rows(spark):
    docs = odd_docs(spark)
    got = lm.lm_scores(docs.withColumn("word", F.lit("clash"))).collect()
    count: Counter = Counter()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(t.encode().lower().split())
            count["end"] += 1
    n, v = sum(count.values()), len(count)
    want = sorted(
        (round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*t.encode().lower().split(), "end"]), 6)) for _, t in rows
    )
    assert sorted(round(r.base_score, 6) for r in got) == pytest.approx(want)
    assert {r.train_tokens for r in got} == {n} and all(r.score <= 0 for r in got)
    assert lm.lm_scores(docs.limit(0)).count() == 0


def test_lm_beats_the_base_on_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("given tables absent")
    got = QUERIES["op9_lm_scoring"](spark, folder).where("held_out")
    score, base = got.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base


def test_lm_gradient():
    voc = lm.Vocabulary({b"a": 5, b"b": 3}, {b"a": 64, b"b": 128}, 10, 3, 2, np.ones(lm.TAIL_CLASSES), np.ones(lm.TAIL_CLASSES))
    net = lm.Network(voc)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    ids = np.array([[64, 128], [2048, 0], [0, 64]])
    klass, member = lm._targets(ids)
    grads = {}
    net._adam = lambda g, *_: grads.update(g)
    net.train_window(ids, klass, member, np.ones_like(ids, bool), np.zeros((2, lm.STATE)), 0.0, {})

    def loss():
        states = [np.zeros((2, lm.STATE))]
        for t in range(3):
            states.append(net.run(ids[t : t + 1], states[-1])[0][-1].astype(float))
        return -net.log_probs(np.concatenate(states[:-1]), klass.ravel(), member.ravel()).mean()

    for k, at in (("wh", (3, 5)), ("wx", (2, 40)), ("b", (20,)), ("wc", (1, 2)), ("emb", (64, 3)), ("wm", (2, 1, 0))):
        w = getattr(net, k)
        old, out = w[at], []
        for d in (1e-2, -1e-2):
            w[at] = old + d
            out.append(loss())
        w[at] = old
        assert grads[k][at] == pytest.approx((out[0] - out[1]) / 2e-2, rel=0.05, abs=2e-5)


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(200, 240)] + [(7, 7), (50, 51), (51, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(31)} == {0} and {got[k] for k in range(200, 240)} == {100} and got[51] == 50
    assert 7 in got and components(spark.createDataFrame([], "a long, b long")).count() == 0


@needs_data
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = corpus_pipeline.run(spark, DATA)
    toxic = spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0 AND quality = 1")
    assert out.count() > 0 and out.join(docs, "doc_id", "left_anti").count() == 0
    assert toxic.count() > 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stage_odd_rows(spark, stage, tmp_path):
    docs = odd_docs(spark)
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for given in (docs, docs.limit(0)):
        out = stage(spark, given, str(tmp_path))
        assert out.count() <= 3 * given.count()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
