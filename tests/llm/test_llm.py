"""Look-alike texts, splitting, encoding, packing and residue."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fundspark.llm import lookalike, packing, residue, splitting, tokens

TEXTS = ["", None, " ", "a", "Le fonds a terminé 2024 à +3,5 %.\n\nl'été — ça va ?", "x" * 5000, "mot " * 4000, "日本語のテキスト。中文", "🙂 emoji 👩‍👩‍👧", "<|endoftext|> dans le texte", "a  b   c\t\td\r\n e", "0123456789" * 50, "'s 'll don't"]


def test_encode_matches_the_library_and_decodes(spark):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(k, t, 1, "z") for k, t in enumerate(TEXTS)] + [(77, "le mot", 1, "z"), (78, "le mot", 2, None)], "doc_id bigint, text string, block int, ids string")
    t = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    enc = tokens.encode(spark, docs).cache()
    got = {r.doc_id: list(r.ids) for r in enc.collect()}
    assert len(got) == len(TEXTS) + 2
    for k, x in enumerate(TEXTS):
        assert got[k] == t.encode(x or "", add_special_tokens=False).ids, x
    back = {r.doc_id: r.text for r in tokens.decode(spark, enc).collect()}
    assert all(back[k] == (x or "") for k, x in enumerate(TEXTS))
    assert tokens.encode(spark, docs.limit(0)).count() == 0


def test_blocks_are_cut_and_rows_kept(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"texte {k % 7} commun") for k in range(300)] + [(None, "sans id")], "doc_id bigint, text string").repartition(3)
    assert tokens.encode(spark, docs).count() == 301
    assert tokens.encode(spark, docs).where("doc_id is null and size(ids) > 0").count() == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120), st.integers(60, 100))
def test_packing_is_valid_and_tight(sizes, capacity):
    box = packing.best_two_fit(np.array(sizes, int), capacity)
    load = np.bincount(box, weights=sizes) if sizes else np.zeros(0)
    assert len(box) == len(sizes) and (load <= capacity).all() and (load > 0).all()
    first_fit = []
    for s in sorted(sizes, reverse=True):
        for k, r in enumerate(first_fit):
            if r >= s:
                first_fit[k] -= s
                break
        else:
            first_fit.append(capacity - s)
    assert len(load) <= len(first_fit) + 1


def test_two_fit_replaces_the_smallest():
    # greedy fills 6+3 and leaves 1; 6 with 2+2 fills the ten exactly
    box = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert box[0] == box[2] == box[3] != box[1]


def test_pack_rows(spark):
    items = spark.createDataFrame([(1, 25, "x"), (2, 10, "x"), (3, 0, "x"), (4, None, "x"), (5, 7, "x"), (6, 3, "x")], "doc_id bigint, tokens int, shard string")
    got = packing.pack(items, [("s", 10), ("b", 100)], 1).collect()
    load = {}
    for r in got:
        load[r.spec_code, r.container_id] = load.get((r.spec_code, r.container_id), 0) + r.tokens
        assert r.spec_code == "b" or r.tokens <= 10
    assert all(v <= (10 if k[0] == "s" else 100) for k, v in load.items())
    assert sorted((r.doc_id, r.piece_no, r.tokens) for r in got if r.spec_code == "s") == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 10), (3, 0, 0), (4, 0, 0), (5, 0, 7), (6, 0, 3)]
    assert len([k for k in load if k[0] == "s"]) == 5 and len([k for k in load if k[0] == "b"]) == 1
    assert packing.pack(items.limit(0), [("s", 10)], 1).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#-,;é́日", max_size=400), st.integers(5, 60), st.integers(0, 20), st.integers(40, 200))
def test_pieces_cover_and_keep_the_limits(text, size, overlap, most):
    out = splitting.pieces(text, size, overlap, most)
    assert bool(out) == bool(text)
    overlap = min(overlap, size - 1)
    end, parent_begin = 0, {}
    for no, a, b in out:
        assert 0 < b - a <= size
        if no not in parent_begin:
            assert a == end
            parent_begin[no] = a
        else:
            assert a == max(parent_begin[no], end - overlap)
        end = b
    assert end == len(text)
    assert (len(out) > 1) == (len(text) > min(size, most))
    for no, a in parent_begin.items():
        assert max(b for n, _, b in out if n == no) - a <= most


def test_natural_boundaries():
    text = "# A\n\nUne phrase ici. Une autre ici.\n\n# B\n\n- un\n- deux\n- trois\n"
    got = [text[a:b] for _, a, b in splitting.pieces(text, 45, 0, 1000)]
    assert got == ["# A\n\nUne phrase ici. Une autre ici.\n\n", "# B\n\n- un\n- deux\n- trois\n"]
    assert [text[a:b] for _, a, b in splitting.pieces(text, 25, 0, 1000)][0].endswith("ici. ")


def test_nested_lists_tables_and_fences():
    cut = lambda text, size: [text[a:b] for _, a, b in splitting.pieces(text, size, 0, 10_000)]
    items = "- un\n  - un un\n  - un deux\n- deux\n  - deux un\n"
    assert cut(items, 30) == ["- un\n  - un un\n  - un deux\n", "- deux\n  - deux un\n"]
    table = "Avant le tableau.\n| a | b |\n| 1 | 2 |\n| 3 | 4 |\nAprès lui, la suite."
    assert all(x.count("|") % 3 == 0 for x in cut(table, 34)) and cut(table, 50)[0].startswith("Avant")
    code = "# Titre\n```\n# pas un titre\nx = 1\n```\n\n# Autre\nfin\n"
    assert cut(code, 45) == ["# Titre\n```\n# pas un titre\nx = 1\n```\n\n", "# Autre\nfin\n"]
    assert cut("Un\n===\ntexte\n\nDeux\n---\nautre", 20)[1].startswith("Deux")
    html = "<h1>A</h1>\n<p>un deux</p>\n<h1>B</h1>\n<p>trois</p>\n"
    assert cut(html, 30) == ["<h1>A</h1>\n<p>un deux</p>\n", "<h1>B</h1>\n<p>trois</p>\n"]
    assert cut("1. Un\n\n1.1 Sous un\n\ntexte\n\n2. Deux\n\nfin", 30)[-1].startswith("2. Deux")


def test_split_sections_rows(spark):
    cfg = spark.createDataFrame([("defaut", 20, 5, 50), ("court", 10, 0, 30)], "config_code string, child_size int, child_overlap int, parent_max_chars int")
    data = [(1, "mot " * 20, None), (2, "court", "court"), (3, None, "court"), (4, "", None), (5, " " * 45, "court"), (6, "mot " * 20, "inconnu"), (7, "x" * 20_000, "court")]
    secs = spark.createDataFrame(data, "section_id bigint, text string, config_code string").withColumn("child_size", F.lit("clash"))
    out = splitting.split_sections(secs, cfg)
    rows = out.collect()
    for key, text, _ in data:
        own = sorted((r for r in rows if r.section_id == key), key=lambda r: r.piece_no)
        covered = "".join(r.text[(own[k - 1].end - r.begin) if k and own[k - 1].parent_no == r.parent_no else 0 :] for k, r in enumerate(own))
        assert covered == (text or "")
    found = {tuple(r) for r in splitting.over_limit(out).collect()}
    assert found == {(k, n) for k in (1, 5, 6, 7) for n in ("child_size", "parent_max_chars")}
    wide = spark.createDataFrame([("defaut", 100, 5, 30)], "config_code string, child_size int, child_overlap int, parent_max_chars int")
    below = spark.createDataFrame([(1, "x" * 48, None), (2, "y" * 120, None), (3, "z" * 30, None)], "section_id bigint, text string, config_code string")
    assert {tuple(r) for r in splitting.over_limit(splitting.split_sections(below, wide, with_text=False)).collect()} == {(1, "parent_max_chars"), (2, "child_size"), (2, "parent_max_chars")}
    assert splitting.split_sections(secs.limit(0), cfg).count() == 0


SAME = [("Fonds A", "Fonds А"), ("Ｆｏｎｄｓ", "Fonds"), ("été", "été"), ("fi", "ﬁ"), ("a b", "a b"), ("cd", "c​d"), ("so­it", "soit"), ("K", "K"), ("１２", "12"), ("x-y", "x‑y"), ("o", "ο")]
OTHER = [("été", "ete"), ("Fonds", "fonds"), ("m²", "m2"), ("10", "11"), ("è", "é"), ("mot a", "mot b"), ("a–b", "a-b"), ("σ", "o")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(a, b):
    assert lookalike.normal_form(a, True) == lookalike.normal_form(b, True) and lookalike.normal_form(a) == lookalike.normal_form(b)


@pytest.mark.parametrize("a, b", OTHER)
def test_other_look(a, b):
    assert lookalike.normal_form(a, True) != lookalike.normal_form(b, True)


def test_normal_form_is_stable():
    assert lookalike.normal_form("  ＳＴＲＡẞＥ　 x² ") == "strasse x2"
    for t in [t for t in TEXTS if t] + [a for p in SAME + OTHER for a in p] + ["İstanbul", "ﬀß²", "ΐ"]:
        for look in (False, True):
            assert lookalike.normal_form(lookalike.normal_form(t, look), look) == lookalike.normal_form(t, look)


def test_look_alike_pairs_against_brute_force(spark):
    random.seed(4)
    base = ["Le fonds A", "Une part B", "m² et m2"]
    change = [lambda s: s, lambda s: s.replace("a", "а"), lambda s: s.replace(" ", " "), lambda s: s + "​", lambda s: s.upper()]
    data = [(k, random.choice(change)(random.choice(base)), 0) for k in range(60)] + [(100, None, 0), (101, "", 0), (102, "  ", 0), (103, "​", 0)]
    rows = spark.createDataFrame(data, "id bigint, text string, look_key int")
    got = {tuple(r) for r in lookalike.look_alike_pairs(rows).collect()}
    want = {
        (a[0], b[0]) for a, b in itertools.combinations(data[:60], 2) if a[1] != b[1] and lookalike.normal_form(a[1], True) == lookalike.normal_form(b[1], True)
    }
    assert got == want and want
    assert lookalike.normalise(rows).count() == 64 and lookalike.look_alike_pairs(rows.limit(0)).count() == 0


RESIDUE = [
    "Frais de {{devise}} %.", "vaut {0}, avec", "Le [NOM DU FONDS] verse", "<date à insérer>", "au #REF! janvier", "XX,XX %", "NaN.", "la part $ISIN vaut", "Votre texte ici.", "Lorem ipsum dolor sit amet commodo.",
    "<html><body><h1>Erreur 503 – Le certificat a expiré</h1></body></html>", "HTTP 500 – EL SERVIDOR NO RESPONDE", "Veuillez activer JavaScript pour afficher cette page.", "Please enable JavaScript.", "en ................ (à renseigner)",
    "valeur &&date_vl; fin", "__SRI__, p. 3", "Access denied.", "Accès refusé.", "Hier steht ein Blindtext.",
]
CONTENT = [
    "L'ensemble {1, 2, 3} désigne", "R_{t} = NAV_{t} / NAV_{t-1} - 1", "pour la part D [1][2].", "Les clients <5 % du capital", "champs entre crochets [a] à [f]", "Le portail a répondu par une erreur 503 le 3 mars.",
    "La demande d'accès refusée par le dépositaire a fait", "contrôles en Python et en JavaScript depuis 2019", "Au cours du XXe siècle", "Am 3. März meldete das Portal den Fehler 503.", "Access was denied to two brokers after", "<|endoftext|>",
    "Frais d'entrée ............ 12", "la région « Europe » atteint 17,40 % du", "A placeholder index is used until", "Commission de surperformance : n.a.", "",
]


# sentences that the lexicon wasn't made from
HELD_OUT_RESIDUE = [
    "This page isn't working", "Just a moment... Verifying you are human", "Oops! That page can’t be found", "Seite wurde nicht gefunden", "you don't have permission to access this resource",
    "muss JavaScript aktiviert sein", "Debe activar JavaScript", "needs JS to work", "Insert text here", "Texte à remplacer", "Sed ut perspiciatis unde omnis iste natus error sit voluptatem", "Hello %(name)s",
    "The requested URL was not found on this server.", "Votre session n'est plus valide. Veuillez vous reconnecter.", "Unable to connect to the database", "La página solicitada no existe", "Platzhaltertext",
]
HELD_OUT_CONTENT = [
    "Un incident technique chez le dépositaire a retardé la valeur liquidative", "A technical problem at the custodian delayed the valuation", "We are sorry to announce the departure of our manager",
    "contact support at the transfer agent", "Lo sentimos por los inversores", "why trading venues return a bad gateway", "The fund is not available to US persons.", "Aucune donnée n'est disponible avant 2015.",
    "Le rapport annuel est disponible sur simple demande.", "Please read the prospectus before investing.", "Der Dienst wurde 2019 eingestellt.", "The custodian refused the transfer.", "L'accès au marché chinois reste limité.",
]


def test_residue_of_held_out_sentences():
    found = [t for t in HELD_OUT_RESIDUE if residue.residue_spans(t)]
    wrong = [t for t in HELD_OUT_CONTENT if residue.residue_spans(t)]
    assert len(found) >= 0.8 * len(HELD_OUT_RESIDUE) and not wrong
    assert residue.residue_spans("Texte.\nPage introuvable\nSuite du texte.") == [(7, 24, "error")]


def test_sizes_are_those_of_the_ids(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id bigint, text string")
    want = {r.doc_id: len(r.ids) for r in tokens.encode(spark, docs).collect()}
    assert {r.doc_id: r.tokens for r in tokens.sizes(spark, docs).collect()} == want


def test_residue_rows(spark):
    data = [(k, t, "x") for k, t in enumerate(RESIDUE + CONTENT + [None, "mot " * 50_000 + "{{isin}}"])]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, kinds string")
    got = {r.doc_id: r for r in residue.marked(docs).collect()}
    for k, t in enumerate(RESIDUE):
        assert got[k].excluded, t
    for k, t in enumerate(CONTENT, len(RESIDUE)):
        assert not got[k].excluded, t
    n = len(RESIDUE) + len(CONTENT)
    assert not got[n].excluded and got[n].coverage == 0 and got[n + 1].excluded and got[n + 1].kinds == ["field"]
    assert residue.marked(docs).where("coverage > 1").count() == 0 and residue.residue(docs.limit(0)).count() == 0
    assert residue.marked(docs, 0.5).where("excluded").count() < residue.marked(docs).where("excluded").count()


def test_residue_of_any_length():
    from fundspark.llm.residue import residue_spans

    long = "This page could not be found and the server is not available, " * 8 + "please try again later"
    assert len(long) > 300 and [k for _, _, k in residue_spans(long)] == ["error"]
    assert [k for _, _, k in residue_spans("Frais : {{ fund.fees | default('" + "ab " * 30 + "') }} par an")] == ["field"]
    assert residue_spans("The manager explained that the server of the custodian was unavailable, " * 8 + "and investors bought bonds") == []
