"""Keyword matching against a plain search, in every strategy."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tickertide.operators import automaton, dedup, matching
from tickertide.schemas import AI_TERMS, CONTEXTS, LEXICON, PARTNER_ROLES
from tickertide.sources.lexicon import load_lexicon, tables_from_mappings

LEX = [
    ("A", "alpha", "identity"),
    ("A", "gen x", "partners"),
    ("A", "beta corp", "competitors"),
    ("B", "beta", "identity"),
    ("B", "x-1", "products"),
    ("B", "Alpha ", "lab_partners"),
    ("C", "a b c", "identity"),
    ("C", ".net", "products"),
    ("C", "+", "products"),
    ("C", " ", "identity"),
    ("D", "two  blanks", "identity"),
]
AI = [("ai", "ai_buzz_phrases"), ("deep net", "ai_buzz_phrases")]


def found(text, keyword):
    k = keyword.lower().strip()
    if not k:
        return False
    return k in text if " " in k else bool(re.search(r"\b" + re.escape(k) + r"\b", text))


def expected(rows):
    out = []
    for i, h in rows:
        h = " ".join(h.lower().strip().split())
        for t in sorted({t for t, k, _ in LEX if found(h, k)}):
            partner = any(found(h, k) for tt, k, r in LEX if tt == t and r in PARTNER_ROLES)
            out.append((i, t, any(found(h, k) for k, _ in AI), partner))
    return sorted(out)


def headlines():
    rng = random.Random(7)
    words = ["alpha", "oxygen", "x", "xy", "beta", "corp", "corps", "x-1", "a", "b", "c", "cc", "asp.net",
             ".net", "é", "ai", "deep", "network", "nets", "two", "blanks", "a+b", "+", "Alpha's", "gen_x"]
    rows = [(i, rng.choice([" ", "  ", " "]).join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(400)]
    return rows + [(400, ""), (401, "alpha"), (402, "alpha")]


def got(df):
    rows = df.select("i", "ticker", "is_ai_related", "is_proxy_partnership").collect()
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("strategy", ["auto", "token", "crowded"])
def test_match_equals_plain_search(spark, strategy, monkeypatch):
    if strategy == "crowded":
        monkeypatch.setattr(matching, "SLOTS", 4)
        strategy = "token"
    rows = headlines()
    h = spark.createDataFrame(rows, "i int, headline string")
    lex, ai = spark.createDataFrame(LEX, LEXICON), spark.createDataFrame(AI, AI_TERMS)
    assert got(matching.match_tickers(h, lex, ai, strategy)) == expected(rows)
    ai_rows = [r for r in expected(rows) if r[2]]
    assert got(matching.match_tickers(h, lex, ai, strategy, ai_only=True)) == ai_rows


def test_inline_match_has_no_shuffle_and_searches_once(spark):
    h = spark.createDataFrame(headlines(), "i int, headline string")
    lex, ai = spark.createDataFrame(LEX, LEXICON), spark.createDataFrame(AI, AI_TERMS)
    matched = dedup.ai_only_filter(matching.match_tickers(h, lex, ai))
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan


def test_match_of_union_is_union_of_matches(spark):
    h = spark.createDataFrame(headlines(), "i int, headline string")
    lex, ai = spark.createDataFrame(LEX, LEXICON), spark.createDataFrame(AI, AI_TERMS)
    twice = got(matching.match_tickers(h.unionAll(h), lex, ai))
    assert twice == sorted(got(matching.match_tickers(h, lex, ai)) * 2)


def test_flags(spark):
    rows = headlines()
    h = spark.createDataFrame(rows, "i int, headline string").withColumn("ticker", F.lit("A"))
    ai = spark.createDataFrame(AI, AI_TERMS)
    lex = spark.createDataFrame(LEX, LEXICON)
    texts = {i: " ".join(t.lower().split()) for i, t in rows}
    for r in matching.ai_flag(h, ai).collect():
        assert r.is_ai_related == any(found(texts[r.i], k) for k, _ in AI)
    for r in matching.partnership_flag(h, lex).collect():
        assert r.is_proxy_partnership == found(texts[r.i], "gen x")


def test_headline_context(spark, monkeypatch):
    notes = [("NVDA", "Blackwell", "big", 0), ("NVDA", "B200", "big", 1), ("NVDA", "GB200", "big", 2), ("A", "x", "y", 0)]
    contexts = spark.createDataFrame(notes, CONTEXTS)
    rows = spark.createDataFrame(
        [("Nvidia GB200 ships", ["A", "NVDA"]), ("x GB200", ["A", "NVDA"]), ("none", ["NVDA"]), ("GB200", ["Z"])],
        "headline string, tickers array<string>",
    )
    want = {
        "Nvidia GB200 ships": "This news relates to big; big.",
        "x GB200": "This news relates to y; big; big.",
        "none": None,
        "GB200": None,
    }
    assert {r.headline: r.context for r in matching.headline_context(rows, contexts).collect()} == want
    # Notes beyond the automaton's size are joined by key.
    monkeypatch.setattr(automaton, "AUTOMATON_LETTERS", 2)
    assert {r.headline: r.context for r in matching.headline_context(rows, contexts).collect()} == want


def test_headline_context_by_key_equals_inline(spark):
    notes = [("A", "x", "ctxA", 0), ("B", "long word", "ctxB", 1), ("B", "x", "b1", 0), ("B", "İst", "b2", 2), ("C", "x", "", 0)]
    contexts = spark.createDataFrame(notes, CONTEXTS)
    rows = spark.createDataFrame(
        [("x long word", ["A"]), ("x long word", ["B"]), ("x long word", ["B", "A"]), ("x long word", ["A"])]
        + [("long  word", ["B"]), ("", ["A"]), (None, ["A"]), ("x", None), ("x", []), ("x", ["C", "Z"])],
        "headline string, tickers array<string>",
    )

    def seen(strategy):
        out = matching.headline_context(rows, contexts, strategy).collect()
        return sorted((str(r.headline), str(r.tickers), str(r.context)) for r in out)

    assert seen("token") == seen("auto")
    assert ("x long word", "['B', 'A']", "This news relates to b1; ctxB; ctxA.") in seen("token")


def test_headline_tickers(spark):
    rows = spark.createDataFrame([("h", "B"), ("h", "A"), ("h", "A"), ("h", " "), ("g", None)], "headline string, ticker string")
    assert [tuple(r) for r in matching.headline_tickers(rows).collect()] == [("h", ["A", "B"])]


def test_load_lexicon(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "terms.yaml").write_text(yaml.safe_dump({"ai_buzz_phrases": ["AI", ""], "ai_buzz_entities": ["LabOne"]}))
    rel = tmp_path / "rel"
    rel.mkdir()
    company = {
        "metadata": {"target_ticker": "abc"},
        "identity": {"company_name": "ABC Corp ", "aliases": ["ABC", "abc", "ABC"], "key_people": ["Jo Doe"]},
        "subsidiaries": {"Sub_One": {"weight": 1}, "Sub_Two": {"aliases": ["S2"], "catalyst": "late"}},
        "products": {"Chip_X": {"aliases": ["CX", "S2"], "context": "early"}},
        "ecosystem": {
            "lab_partners": {"Lab_One": {"aliases": ["L1"]}, "Lab_Two": None},
            "partners": [{"name": "Part_ner", "keywords": ["PK"]}, {"name": ""}],
            "competitors": [{"name": "Rival", "aliases": ["R1"], "keywords": ["unused"]}],
        },
        "scoring": {"ignored": ["zzz"]},
    }
    (rel / "b.yaml").write_text(yaml.safe_dump(company))
    (rel / "a.yaml").write_text(yaml.safe_dump({"identity": {"aliases": ["no ticker"]}}))
    tables = load_lexicon(spark, tmp_path / "terms.yaml", rel)
    assert sorted(tuple(r) for r in tables.lexicon.collect()) == sorted(
        [("ABC", k, "identity") for k in ("ABC Corp", "ABC", "abc", "Jo Doe")]
        + [("ABC", k, "subsidiaries") for k in ("Sub One", "Sub Two", "S2")]
        + [("ABC", k, "products") for k in ("Chip X", "CX", "S2")]
        + [("ABC", k, "lab_partners") for k in ("Lab One", "L1", "Lab Two")]
        + [("ABC", k, "partners") for k in ("Part_ner", "PK")]
        + [("ABC", k, "competitors") for k in ("Rival", "R1")]
    )
    assert [tuple(r) for r in tables.ai_terms.collect()] == [("AI", "ai_buzz_phrases"), ("LabOne", "ai_buzz_entities")]
    notes = {r.keyword: (r.context, r.position) for r in tables.contexts.collect()}
    assert notes == {"Chip X": ("early", 0), "CX": ("early", 1), "S2": ("late", 2), "Sub Two": ("late", 3)}


def test_last_file_of_a_ticker_counts(spark):
    files = [
        {"metadata": {"target_ticker": t}, "identity": {"aliases": [kw]}, "products": {kw: {"context": f"n {kw}"}}}
        for t, kw in (("a", "one"), ("b", "two"), ("A", "three"))
    ]
    tables = tables_from_mappings(spark, {}, files)
    assert sorted({(r.ticker, r.keyword) for r in tables.lexicon.collect()}) == [("A", "three"), ("B", "two")]
    assert sorted(r.context for r in tables.contexts.collect()) == ["n three", "n two"]


def test_empty_lexicon_matches_nothing(spark):
    tables = tables_from_mappings(spark, {}, [])
    h = spark.createDataFrame([("alpha",)], "headline string")
    assert matching.match_tickers(h, tables.lexicon, tables.ai_terms).count() == 0
    assert matching.ai_flag(h, tables.ai_terms).first().is_ai_related is False


def test_automaton_finds_every_keyword_of_a_large_table(spark):
    """More keywords than any plan could hold as literals, overlapping and nested ones among them."""
    rng = random.Random(8)
    letters = "abcé_1-. "
    words = {"".join(rng.choices(letters, k=rng.randint(1, 6))).strip() for _ in range(3000)} - {""}
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))).split()) for _ in range(200)]
    texts = [" ".join(rng.sample(texts, 8)) for _ in range(60)] + ["", "a" * 50_000]
    entries = spark.createDataFrame([(w, len(w)) for w in words] * 2, "keyword string, size int")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").repartition(3)
    found = rows.select("i", automaton.keyword_finder(entries)(F.col("t")).alias("f")).collect()
    assert {r.i: sorted((e.keyword, e.size) for e in r.f) for r in found} == {
        i: sorted((w, len(w)) for w in words if t is not None and plain_found(t, w)) for i, t in enumerate([*texts, None])
    }


def plain_found(text, word):
    if " " in word:
        return word in text
    return re.search(rf"\b{re.escape(word)}\b", text) is not None


def test_tables_beyond_the_bound_are_joined(spark, monkeypatch):
    monkeypatch.setattr(automaton, "AUTOMATON_LETTERS", 20)
    h = spark.createDataFrame(headlines(), "i int, headline string")
    lex, ai = spark.createDataFrame(LEX, LEXICON), spark.createDataFrame(AI, AI_TERMS)
    out = matching.match_tickers(h, lex, ai)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    assert got(out) == expected(headlines())


def test_a_table_beyond_the_bound_moves_no_row_per_keyword(spark, monkeypatch):
    """Keywords that share their surroundings of a blank: every text would meet all of them in a join on keys."""
    monkeypatch.setattr(automaton, "AUTOMATON_LETTERS", 60)
    monkeypatch.setattr(matching, "_found_by_key", None)
    words = ["alpha", "beta", "x-1", "é", "gen_x", "of the", "+", "ai"]
    lex = [(w[0], f"{w} of the {v}", r) for w in words for v in words for r in ("partners", "identity")]
    lex += [(w[:1].upper(), w, "identity") for w in words] + [("Z", "", "identity"), ("Z", None, "x")]
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words + ["of", "the"], k=rng.randint(1, 12)))) for i in range(150)]
    rows += [(150, "  ALPHA  of the\tbeta "), (151, ""), (152, None)] + [(153, "alpha of the beta ai")] * 40
    h = spark.createDataFrame(rows, "i int, headline string").repartition(3)
    entries, ai = spark.createDataFrame(lex, LEXICON), spark.createDataFrame([("ai", "x"), ("the al", "x")], AI_TERMS)
    want = []
    for i, text in rows:
        text = " ".join((text or "").lower().split())
        is_ai = any(found(text, k) for k in ("ai", "the al"))
        hits = {(t, r) for t, k, r in lex if k and found(text, k)}
        want += [(i, t, is_ai, (t, "partners") in hits) for t in {t for t, _ in hits}]
    out = matching.match_tickers(h, entries, ai)
    assert got(out) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate explode" not in plan
    texts = {i: " ".join((t or "").lower().split()) for i, t in rows}
    assert {r.i: r.is_ai_related for r in matching.ai_flag(h, ai).collect()} == {
        i: found(t, "ai") or found(t, "the al") for i, t in texts.items()
    }


@pytest.mark.parametrize("letters", [None, 8])
def test_notes_by_key_move_no_text(spark, monkeypatch, letters):
    """Long texts stay where they are; repeated notes, repeated tickers and repeated rows count as given."""
    if letters:
        monkeypatch.setattr(automaton, "AUTOMATON_LETTERS", letters)
    notes = [("A", "Alpha beta", "a1", 1), ("A", "beta", "a0", 0), ("B", "beta", "b", 0), ("B", "beta", "b", 0), ("C", "zz", "c", 0)]
    notes += [(None, "beta", "n", 0), ("A", "alphabet", "never", 5)]
    contexts = spark.createDataFrame(notes, CONTEXTS)
    texts = [f" Alpha BETA {'filler words ' * 300}", "alpha", "alphabeta", None]
    rows = [(i, t, g) for i, t in enumerate(texts) for g in (["A"], ["B", "A"], ["B", "B"], ["C", None], [], None)] * 2
    h = spark.createDataFrame(rows, "i int, headline string, tickers array<string>")
    out = matching.headline_context(h, contexts, "token").select("i", "tickers", "context")

    def want(text, tickers):
        hits = [
            (at, pos, k.lower(), c)
            for at, t in enumerate(tickers or []) for g, k, c, pos in notes
            if t is not None and g == t and text is not None and k.lower() in text.lower()
        ]
        return f"This news relates to {'; '.join(h[3] for h in sorted(hits))}." if hits else None

    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(str((i, g, want(t, g))) for i, t, g in rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan
    moved = [line for line in plan.split("\n") if "Exchange" in line]
    assert moved and not any("headline" in line for line in moved)


@pytest.mark.parametrize("dealt", [16, 1])
def test_windows_find_what_a_plain_search_finds(spark, monkeypatch, dealt):
    """Keywords of all lengths, nested, overlapping, of several owners; texts across blocks, in one slice and in several."""
    monkeypatch.setattr(automaton, "AUTOMATON_LETTERS", 500)
    monkeypatch.setattr(matching.windows, "DEALT", dealt)
    rng = random.Random(9)
    letters = "abcé𝔘_1-. "
    words = {"".join(rng.choices(letters, k=rng.choice([1, 2, 3, 5, 8, 17, 20, 33, 40, 70]))).strip() for _ in range(1500)}
    words = sorted(words - {""})
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))).split()) for _ in range(200)]
    texts = [" ".join(rng.sample(texts, 6) + rng.sample(words, 4)) for _ in range(80)]
    texts += ["", None, "b" * 140_000 + f" {words[5]} " + "c" * 140_000, *words[:30], "\0 a\0"]
    entries = [(w, f"T{len(w) % 4}", k % 3 == 0) for k, w in enumerate(words)] + [(w, None, None) for w in words[::5]]
    table = spark.createDataFrame(entries * 2, "keyword string, ticker string, partner boolean").repartition(3)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    out = matching.find_owners(rows, "t", table)
    assert out.columns == ["i", "t", "_found"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Rows are dealt over the tasks by this test alone: matching moves none.
    assert "MapInArrow" in plan and plan.count("Exchange") == rows._jdf.queryExecution().executedPlan().toString().count(
        "Exchange"
    )
    got = {r.i: sorted(((f.ticker, f.partner) for f in r._found), key=repr) for r in out.collect()}
    want = {}
    for i, t in enumerate(texts):
        hits = {w for w in words if t and plain_found(t, w)}
        want[i] = sorted({(ticker, partner) for w, ticker, partner in entries if w in hits}, key=repr)
    assert got == want


def test_windows_with_equal_hashes_are_told_apart(spark, tmp_path, monkeypatch):
    """A hash leads to keywords, whose letters count."""
    w = matching.windows
    monkeypatch.setattr(w, "_hashes", lambda points: w.np.full(len(points), 7, w.np.uint64))
    entries = w.pa.table({"keyword": ["a b", "c d", "e f"], "ticker": ["A", "C", "E"]})
    codes, firsts = w._write(str(tmp_path / "k"), iter([entries]), True)
    tables = w.Tables(str(tmp_path / "k"), firsts)
    (table,) = tables.of[3]
    points = w._points(f"{w.GAP}c d c d a b{w.GAP}")
    places = w.np.array([1, 3, 5, 9])
    found, at = table.found(points, places, w.np.full(4, 7, w.np.uint64))
    right = table.checked(points, found, at)
    assert sorted((p, list(codes.owners)[table.codes[k]][0]) for p, k in zip(found[right], at[right])) == [
        (1, "C"), (5, "C"), (9, "A")
    ]
