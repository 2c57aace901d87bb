"""Problems 1 to 5 on small pages: rules, models and queries, with odd rows."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from make import COMMON, write

from pagewright.llm import furniture, lines, queries, residue
from pagewright.llm.blocks import BAD, GOOD, blocks_of, mark_blocks
from pagewright.llm.filters import validate
from pagewright.llm.lexicon import INVISIBLE, tidy
from pagewright.llm.linear import Stretches, codes_of, fit, score, tokens_of
from pagewright.llm.pages import _pack

from pagewright.llm.stuffing import LINKS, PROSE, SIGNS, LineModel, fit_line_model, read_signs, states_of

STOP = frozenset(w for v in COMMON.values() for w in v)
WORDS = "harbour council village timetable market bridge letter school railway garden winter supper boat window ladder".split()


def prose(seed, sentences=6):
    rng = random.Random(seed)
    out = []
    for _ in range(sentences):
        body = [rng.choice(WORDS) if k % 2 else rng.choice(COMMON["en"]) for k in range(18)]
        out.append(" ".join(body).capitalize() + ".")
    return " ".join(out)


def page(i, text, site="news.example", **more):
    return {"result_id": i, "url": f"https://www.{site}/p/{i}", "text_content": text, "title": f"Story number {i} of the harbour", "lang": "en", **more}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    rows = []
    for i in range(40):
        body = "\n\n".join(prose(100 * i + k) for k in range(3))
        rows.append(page(i, f"Skip to main content\n\n{body}\n\nShare this story   with {i} friends\n\n© {2000 + i} News Media. All rights reserved."))
    name = lambda k: "".join("bdfglmnprstv"[(k * m + m) % 12] + "aeiou"[(k + m) % 5] for m in (3, 5, 7)).capitalize()
    things = "Lamp Kettle Rope Ladder Notebook Saddle Bell Tarpaulin".split()
    listing = "\n".join(f"{k}. {things[k % 8]} no. {k * 7}, {name(k)} / {name(k + 40)}" for k in range(1, 30))
    rows.append(page(50, listing))
    rows.append(page(51, "\n".join(f"Holroford\t{k}\t{k * 3}.50\t{k * 9}" for k in range(30))))
    tags = "\n".join(", ".join(random.Random(k * 9 + j).choice(["cheap lamps", "best boots", "fast loans", "lamps online"]) for j in range(14)) for k in range(8))
    rows.append(page(60, tags, title="Cheap lamps Holroford"))
    rows.append(page(70, "The requested URL /x was not found on this server.", title="404 Not Found"))
    rows.append(page(71, prose(7) + " The {{ first_name }} council voted. " + prose(8)))
    rows.append(page(72, prose(9) + ' In the lesson she wrote "{{ first_name }}" on the board and explained the template engine. ' + prose(10)))
    rows += [page(80, ""), page(81, None), page(82, "\n\n \n"), {"result_id": 83}, {"result_id": None, "text_content": "x"}, page(50, listing)]
    rows.append(page(90, ("word " * 20 + "\n") * 4000))
    folder = tmp_path_factory.mktemp("pages")
    return write(spark, folder, extraction_results=rows, audit_entries=[{"audit_id": 1, "url": "https://www.news.example/p/1", "diagnostics": (12, 3), "audited_at": None}])


def ids(df):
    return {r["result_id"] for r in df.collect()}


def test_found(spark, base):
    run = queries.queries()
    residue, stuffed, lists = ids(run["p4_found"](spark, base)), ids(run["p5_found"](spark, base)), ids(run["p1_found"](spark, base))
    assert {70, 71} <= residue and 72 not in residue and not residue & set(range(40))
    assert 60 in stuffed and not stuffed & {*range(40), 50, 51}
    assert {50, 51, 60} <= lists and not lists & {*range(40), 70, 71, 72, 80, 81}
    assert stuffed <= lists and not residue & lists


def test_repeated_lines(spark, base):
    got = {(r["result_id"], r["line_no"]) for r in lines.p2_found(spark, base).collect()}
    assert {(i, n) for i in range(40) for n in (1, 9, 11)} <= got
    clean = {r["result_id"]: r for r in lines.p2_clean(spark, base).where("result_id in (3, 81)").collect()}
    assert clean[3]["lines_deleted"] == 3 and "Share" not in clean[3]["clean_text"] and clean[81]["clean_text"] is None


def test_bodies(spark, base):
    got = {(r["result_id"], r["line_no"]) for r in queries.queries()["p3_found"](spark, base).collect()}
    assert {(i, n) for i in range(40) for n in (1, 9, 11)} <= got and not {(i, n) for i in range(40) for n in (3, 5, 7)} & got
    body = {r["result_id"]: r["main_body"] for r in queries.queries()["p3_body"](spark, base).collect()}
    assert body[1].startswith(prose(100)) and body[80] == "" and body[83] == ""


def test_statistics(spark, base):
    rows = {r["result_id"]: r for r in queries.queries()["p1_stats"](spark, base).collect()}
    assert rows[1]["audit_avg_sentence_length"] == 12 and rows[1]["audit_paragraphs"] == 3 and rows[2]["audit_paragraphs"] is None
    assert rows[51]["common_word_share"] < 0.1 < rows[1]["common_word_share"] and rows[51]["z_common"] < -5
    assert 0 <= rows[1]["pct_common_word_share"] <= 1 and rows[80]["body_words"] == 0
    assert queries.queries()["p4_validation"](spark, base).count() == 2


@pytest.mark.parametrize("name", ["p1_found", "p1_stats", "p2_found", "p2_clean", "p3_found", "p3_body", "p4_found", "p4_validation", "p5_found"])
def test_empty_tables_and_clashing_columns(spark, tmp_path, name):
    assert queries.queries()[name](spark, write(spark, tmp_path, extra=["residue", "facts", "site", "q"])).count() <= 2


# --- problem 2 against brute force ---------------------------------------------------


def brute(rows, least):
    drop = dict.fromkeys(map(ord, INVISIBLE))
    seen, places = defaultdict(set), []
    for i, site, text in rows:
        for n, line in enumerate(text.split("\n"), 1):
            key = "".join(re.sub(r"\d+", "0", line.translate(drop).upper().lower()).split())
            if key:
                seen[site, key].add(i)
                places.append((i, n, site, key))
    return {(i, n) for i, n, site, key in places if len(seen[site, key]) >= least}


def test_lines_match_brute_force(spark):
    rng = random.Random(3)
    forms = ["Share  this", "share​this", "SHARE THIS ", "12 comments", "7 comments", "Straße 4", "STRASSE 99", "x y", "unique %d", "", "\t"]
    rows = [(i * 977, f"s{rng.randrange(3)}.example", "\n".join(f % i if "%" in f else f for f in rng.choices(forms, k=6))) for i in range(120)]
    rows += rows[:5]
    df = spark.createDataFrame([(i, f"http://m.{s}/a", t) for i, s, t in rows], "result_id long, url string, text_content string")
    spread = lines.line_rows(df)
    got = {tuple(r) for r in lines.occurrences(spread, lines.repeated_lines(spread)).distinct().collect()}
    assert got == brute(rows, 5)


def test_dense_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(lines, "DENSE_FROM", 8)
    df = spark.range(60).selectExpr("id * 3 as result_id", "'http://a.example' as url", "if(id % 2 = 0, 'same line', 'other ' || chr(int(97 + id % 26)) || chr(int(97 + id / 26))) as text_content")
    spread = lines.line_rows(df)
    bitmaps = lines.repeated_lines(spread)
    assert bitmaps.where("dense is not null").count() > 0
    got = {r["result_id"] for r in lines.occurrences(spread, bitmaps).collect()}
    assert {i * 3 for i in range(0, 60, 2)} <= got


# --- rules and models ----------------------------------------------------------------


def sampled(texts, markup=True):
    """Pages of one site with a site line above and a list of other pieces below."""
    out = []
    for k, body in enumerate(texts):
        text = f"Home\n\nPass this on to {k} friends\n\n{body}\n\nOther pieces of ours\n\nA piece about the quay {k}\n\nA piece about the mill {k}"
        inner = "".join(f"<p>{x}</p>" for x in body.split("\n\n"))
        html = f"<nav><a href='#'>Home</a></nav><div class='share'>Pass this on to {k} friends</div><article>{inner}</article><aside><h3>Other pieces of ours</h3><li><a href='#'>A piece about the quay {k}</a></li><li><a href='#'>A piece about the mill {k}</a></li></aside>"
        out.append((text, html if markup else None))
    return out


def learned(texts):
    pages = [blocks_of(text, html, STOP) for text, html in sampled(texts)]
    codes, signs, labels, main = [], [], [], []
    for blocks in pages:
        codes += [b.codes for b in blocks]
        signs += [furniture.signs_of(b, "daily", []) for b in blocks]
        labels += furniture.labels_of(blocks)
        main += [b.role > 0 for b in blocks]
    return furniture.fit_furniture(["s"] * len(pages), [len(p) for p in pages], Stretches(codes, signs), np.array([x for x, _ in labels]), np.array([y for _, y in labels]), np.array(main))


def test_block_rules():
    weights = learned([prose(k) + (f"\n\nThe {WORDS[k % 14]} between the {WORDS[k % 11]}\n\n{prose(k + 50)}\n\n[{k}] The source of it, Newby 199{k % 10}." if k % 2 else "") for k in range(40)])
    for text, html in [*sampled([prose(99) + "\n\nA heading between\n\n" + prose(98) + "\n\n[1] A source, Oldby 2001."]), *sampled([prose(97)], markup=False)]:
        blocks = blocks_of(text, html, STOP)
        furniture.score_lines([(blocks, "daily", ["jo marsh"])], weights)
        mark_blocks(blocks, "Title", ("Jo Marsh",), "Daily")
        body = {b.line_no for b in blocks} - {1, 3, *sorted(b.line_no for b in blocks)[-3:]}
        assert {b.line_no for b in blocks if b.mark == GOOD} == body and all(b.mark in (GOOD, BAD) for b in blocks)
    assert blocks_of(None, None, STOP) == [] and blocks_of("", "<p", STOP) == []


def test_furniture_without_examples_is_none():
    blocks = blocks_of(prose(1), None, STOP)
    none = furniture.fit_furniture([], [], Stretches([], []), np.zeros(0), np.zeros(0), np.zeros(0, bool))
    furniture.score_lines([(blocks, "", [])], none)
    assert all(b.cue < 0 and b.opens < 0 for b in blocks) and tidy("a\u200b  b\u00ad\ufeff ") == "a b"


def test_what_is_judged():
    judged = lambda title, text: residue.judged(title, blocks_of(text, None, STOP))
    assert judged(None, None) == ([], []) and judged(" ", "") == ([], [])
    codes, signs = judged("A title", "One sentence. Another one!\nA line")
    assert len(codes) == len(signs) == 4 and codes[0][0] == residue.TITLE
    assert len(residue.labelled("A title", blocks_of("One sentence. Another one!\nA line", None, STOP))) == 4


def test_linear_classifier_learns():
    texts = [f"Dear {{{{name{k}}}}} friend" for k in range(40)] + [f"Plain title {k}" for k in range(40)]
    stretches = Stretches([codes_of(tokens_of(t.lower())) for t in texts], [()] * 80)
    labels = np.array([1] * 40 + [0] * 40)
    (scores,) = score(stretches, fit(stretches, labels))
    assert ((scores > 0) == (labels == 1)).all()
    (none,) = score(stretches, fit(stretches, np.zeros(80)))
    assert (none < 0).all() and score(Stretches([], []), fit(stretches, labels))[0].shape == (0,)


def test_residue_no_pattern_has_labelled():
    """Half of the planted pages carry notices whose words no pattern knows; they are found for what they share with the others."""
    rng = random.Random(4)
    pages, truth = [], []
    for k in range(400):
        if k % 8 == 0:
            known = k % 16 == 0
            notice = rng.choice(["This page is broken because of an unexpected error", "Nothing is here, the page was not found on this server"]) if known else rng.choice(["This page is broken, sorry", "Nothing is here, the page has gone"])
            pages.append(("Oops", f"{notice} {k}."))
        else:
            pages.append((f"How the harbour was kept {k}", prose(k)))
        truth.append(k % 8 == 0)
    parsed = [(title, blocks_of(text, None, STOP)) for title, text in pages]
    for title, blocks in parsed:
        mark_blocks(blocks, title, (), None)
    both = [(residue.judged(t, b), residue.labelled(t, b)) for t, b in parsed]
    labels = np.array([y for _, given in both for y, _ in given])
    weights = fit(Stretches([c for (cs, _), _ in both for c in cs], [s for (_, ss), _ in both for s in ss]), labels, epochs=16)
    said = residue.are_residue(parsed, weights)
    unlabelled = [k for k in range(400) if k % 16 == 8]
    assert not any(y == 1 for k in unlabelled for y, _ in both[k][1])
    assert sum(said[k] for k in range(0, 400, 16)) == 25 and not any(said[k] for k in range(400) if not truth[k])


def test_validation_against_planted_truth():
    """At one host in five none is trained on; what is reported is what was planted there."""
    hosts = [f"h{k}.example" for k in range(40)]
    held = {h for h in hosts if zlib.crc32(h.encode()) % 5 == 0}
    rows = []
    for h in hosts:
        pages = [(f"Story {k}", prose(k + 7 * len(h))) for k in range(6)] + [("404 Not Found", "The requested page was not found on this server."), ("Story", prose(9) + " The {{ first_name }} council voted. " + prose(8))]
        for title, text in pages:
            blocks = blocks_of(text, None, STOP)
            mark_blocks(blocks, title, (), None)
            kept = [(c, s, *y) for c, s, y in zip(*residue.judged(title, blocks), residue.labelled(title, blocks)) if y[0] >= 0]
            rows.append({"site": h, "phrases": [x[3] for x in kept], "labels": np.array([x[2] for x in kept], np.int8).tobytes(), **dict(zip(("codes", "sizes", "signs", "sign_sizes"), _pack([x[0] for x in kept], [x[1] for x in kept])))})
    seen, unseen = validate(rows)
    assert seen[:2] == ("unseen hosts", len(held)) and seen[2] == 3 * len(held) and seen[3:5] == (0, 0)
    assert unseen[0] == "unseen hosts and phrases" and unseen[2] + unseen[3] <= seen[2]


def test_viterbi_matches_brute_force():
    from itertools import product

    rng = np.random.default_rng(5)
    size = 6
    model = LineModel(np.log(rng.dirichlet(np.ones(size))), np.log(rng.dirichlet(np.ones(size), size)), [np.log(rng.dirichlet(np.ones(k), size)) for k in SIGNS])
    signs = np.stack([rng.integers(0, k, 5) for k in SIGNS], 1)
    emitted = model.scores(signs)

    def score(path):
        return model.start[path[0]] + emitted[0, path[0]] + sum(model.move[a, b] + emitted[t + 1, b] for t, (a, b) in enumerate(zip(path, path[1:])))

    assert score(tuple(model.path(signs))) == pytest.approx(max(score(p) for p in product(range(size), repeat=5)))


def test_line_states():
    linked = "".join(f"<li><a href='#'>Old market piece number {k}</a></li>" for k in range(12))
    page_a = blocks_of("\n".join(f"Old market piece number {k}" for k in range(12)), linked, STOP)
    page_b = blocks_of(prose(4) + "\n" + prose(5), None, STOP)
    model = fit_line_model([tuple(x.astype(np.int8).tobytes() for x in read_signs(p)) for p in (page_a, page_b)] * 5)
    assert set(states_of(page_a, model)) == {LINKS} and set(states_of(page_b, model)) == {PROSE} and len(states_of([], model)) == 0


def test_sketches_against_exact_quantiles(spark):
    from pagewright.llm.quality import RANKS, STATISTICS, place, sketch_quantiles

    rng = np.random.default_rng(1)
    rows = [("en" if k % 3 else "de", *map(float, rng.normal(0.4 if k % 3 else 0.6, 0.05, 5)), 100, 600) for k in range(3000)] + [("fr", 0.4, 0.4, 0.4, 0.4, 0.4, 100, 600)] * 3
    names = [s for s in STATISTICS if s != "body_words"]
    facts = spark.createDataFrame(rows, "base_lang string, " + ", ".join(f"{n} double" for n in names) + ", body_words int, body_chars int")
    quantiles = {r["base_lang"]: r for r in sketch_quantiles(facts).collect()}
    assert set(quantiles) == {"en", "de", "fr"} and quantiles["fr"]["pages"] == 3
    everyone = np.quantile([r[1] for r in rows], 0.5)
    assert abs(quantiles["fr"]["common_word_share"][99] - (3 * 0.4 + 20 * everyone) / 23) < 0.01
    quantiles = {r["base_lang"]: r for r in sketch_quantiles(facts, 0.0).collect()}
    for lang in ("en", "de"):
        values = np.array([r[1] for r in rows if r[0] == lang])
        exact = np.quantile(values, RANKS)
        got = np.array(quantiles[lang]["common_word_share"])
        assert (np.abs([np.mean(values <= g) - r for g, r in zip(got, RANKS)]) < 0.03).all() and np.abs(got - exact).max() < 0.03
    placed = place(facts, sketch_quantiles(facts))
    assert placed.count() == len(rows) and placed.where("base_lang = 'fr' and z_common is null").count() == 0
