"""Encoding, leaks and residue, on small texts."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lookalike.llm import leaks, residue, tokens
from lookalike.llm import residue_seeds as seeds


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")


TEXTS = [None, "", " ", "plain words", "  two  spaces\n\n\nand lines \n", "don't we'll", "<|endoftext|> is text", "日本語のテキスト、漢字", "a" * 3000, "x​y­", "emoji 👩‍👩‍👧 and \U0001d51e", "tabs\t\t\tend\t", "\n" * 400 + "z", "word " * 500]


@pytest.mark.parametrize("options", [{}, {"chunk": 50, "overlap": 20}, {"chunk": 7, "overlap": 3}, {"spread": 100, "overlap": 20}])
def test_chunks_encode_as_the_whole(spark, options):
    got = {r.doc_id: r.ids for r in tokens.encode(docs(spark, TEXTS), **options).collect()}
    whole = tokens.encoding(tokens.VOCABULARY)
    assert got == {i: whole.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}


def test_pieces_of_odd_texts_encode_as_the_whole():
    import random

    rng, coder = random.Random(7), tokens.encoding(tokens.VOCABULARY)
    alphabet = ["a", "B", "é", "'", "s", "re", " ", " ", "\n", "\t", "1", "23", ".", "!", "字", "\U0001d51e", "\u200b", "  "]
    for chunk, overlap in [(5, 2), (16, 4), (40, 16), (1000, 100)]:
        for _ in range(150):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) + rng.choice(["", "a" * 150, " " * 150, "!" * 150])
            assert tokens.encoded_pieces(coder, text, chunk, overlap) == coder.encode_ordinary(text)
    long = "x" * 300_000 + " word" * 1000
    assert tokens.encoded_pieces(coder, long[-6000:], 1000, 100) == coder.encode_ordinary(long[-6000:])
    assert len(tokens.piece_starts(" ".join(["word"] * 1000), 1000, 100)) == 5 and len(tokens.piece_starts(long, 1000, 100)) == 6


def test_agrees_with_the_other_library_and_decodes(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    encoded = tokens.encode(docs(spark, TEXTS))
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: other.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in tokens.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_repeated_and_null_ids_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "abc " * 30), (1, "abc " * 30), (None, "q"), (2, None)], "doc_id bigint, text string")
    whole = len(tokens.encoding(tokens.VOCABULARY).encode_ordinary("abc " * 30))
    assert sorted((r.doc_id or 0, len(r.ids)) for r in tokens.encode(rows, chunk=20, overlap=10).collect()) == [(0, 1), (1, whole), (1, whole), (2, 0)]
    assert tokens.encode(rows.limit(0)).count() == 0


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def found(spark, texts, items, **options):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id bigint, text string, doc_id string")
    return {(r.doc_id, r.item_id) for r in leaks.overlaps(docs(spark, texts), rows, **options).collect()}


def test_thirteen_words_or_a_whole_short_item(spark):
    texts = [f"so {LONG[: LONG.rindex(' ')]} end", LONG.replace("seven", "7"), "One TWO thr­ee four five six sev-\n  en eight​ nine (ten) eleven; twelve thirteen", "short item here", "short item", None, "", " "]
    items = [LONG, "a short item here"[2:], None, "", "short item here"]
    assert found(spark, texts, items) == {(0, 0), (2, 0), (3, 1), (3, 4)}


def test_substitutions(spark):
    one = LONG.replace("three", "3x")
    assert found(spark, [one, LONG.replace("three", "x").replace("ten", "y")], [LONG], wrong=1) == {(0, 0)}
    assert found(spark, [one], [LONG]) == set()


@pytest.mark.parametrize("n", [13, 14, *range(2, 13)])
def test_a_substitution_at_any_place_is_found(spark, n):
    words = [f"w{n}x{k}" for k in range(n)]
    texts = [" ".join(["so", *words[:k], "other", *words[k + 1 :], "end"]) for k in range(n)]
    assert found(spark, texts, [" ".join(words)], wrong=1) == {(k, 0) for k in range(n)}


def test_masks_ignore_any_places_and_one_word_items():
    for wrong in (1, 2, 3):
        for span in range(1, 14):
            for places in combinations(range(span), min(wrong, span)):
                assert any(all(m[:span][k] == "0" for k in places) for m in leaks.masks_for(wrong))
    index = leaks.Index([(5, "alone")], 13, leaks.masks_for(1))
    ids, ends = np.array([-1, 0, -1]), np.array([2, 3])
    assert {tuple(h) for h in index.hits(ids, np.array([0, 0, 1]), ends).T.tolist()} == {(0, 0, 0), (0, 0, 1), (1, 0, 2)}


def test_blocks_and_repeated_rows_change_nothing(spark):
    items = [f"item {i} " + " ".join(f"w{i}x{j}" for j in range(20)) for i in range(30)]
    texts = [f"intro {items[3]} outro", "nothing", items[29], items[29]]
    want = {(0, 3), (2, 29), (3, 29)}
    assert found(spark, texts, items) == found(spark, texts, items, block_bytes=500) == want
    assert found(spark, [], items) == found(spark, texts, []) == set()


def test_every_window_against_brute_force(spark):
    import random

    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(4)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(40)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 9, 30]))) for _ in range(20)] + [texts[0][30:90]]
    want = set()
    for d, t in enumerate(texts):
        for i, e in enumerate(items):
            w, v = leaks.words(e), leaks.words(t)
            n = min(13, len(w))
            if {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} & {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}:
                want.add((d, i))
    assert found(spark, texts, items) == want and want


PROSE = [
    "The ferry left the pier early and the whole class waved until it was out of sight.", "My uncle repaired the old press in the cellar and printed a poster for the fair.",
    "We scanned every slide twice because the first pass was far too dark.", "Nach dem Regen standen zwei Boote am Ufer und niemand wollte hinaus.", "Le marché ouvre à six heures et les lanternes restent allumées.",
    "La barca llegó al puerto con las velas rotas y nadie preguntó por qué.", "Вечером мы разбирали коробки с фотографиями и пили чай.", "雨が止むと、子どもたちは橋のそばで凧を揚げた。",
]
RESIDUE = [
    "Dear {{first_name}}, your {{count}} files are ready.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Error 404: page not found", "502 bad gateway", "Please enable JavaScript to view this page.", "TODO: write description",
    "Titel: [[Bildunterschrift]]", "Bitte aktivieren Sie JavaScript.", "Страница не найдена.", "Texto de relleno, sustituir.", "test test blah blah xxx test text",
]
FINE = [
    None, "", " \n ", *PROSE, "When I open the album it says \"404\" for a second and then the cover appears.", "She asked whether lorem ipsum would do for the poster; we wrote a real caption.",
    "In the template editor type {{title}} where the album name should go.", "12:01:44 WARN no vector IMG_12.jpg", "Set EXPORT_DIR to ${HOME}/albums and run the sorter again.",
]


UNSEEN = [
    "Dear [[CUSTOMER]], your order {{order_id}} has shipped.", "Lorem ipsum dolor amet, consectetur elit sed tempor.", "Error 404: this page was not found", "502 Bad Gateway, try again later", "JavaScript must be enabled to view this album.",
    "TODO: add a description", "Bitte schalten Sie JavaScript ein.", "Страница не была найдена.", "Texto de relleno, por favor sustituir.", "Placeholder text, to be replaced.", "You have no permission to view this album.", "Die Seite konnte nicht gefunden werden.",
]


def test_most_wordings_that_no_seed_has_are_found():
    model = residue.Model(residue.seed_counts(), residue.empty_counts())
    known = {residue.plain(p) for s in (*seeds.FILLER, *seeds.ERRORS, *seeds.SCRIPTS) for p in {s, *residue.pieces(s)}}
    forms = [residue.plain(p) for t in UNSEEN for p in residue.pieces(t)]
    assert not known & set(forms)
    assert (model.kinds(forms) != residue.PROSE).mean() >= 0.75
    assert model.kinds([residue.plain(t) for t in ("Lorem ipsum dolor sit amet.", "Error 404: page not found")]).tolist() == [residue.FILLER, residue.NOTICES]


def test_a_corpus_twice_as_large_gives_the_same(spark):
    texts = [*FINE, *RESIDUE]
    once = {r.doc_id for r in residue.found(docs(spark, texts * 3)).collect()}
    twice = {r.doc_id for r in residue.found(docs(spark, texts * 6)).collect()}
    assert {i % len(texts) for i in once} == {i % len(texts) for i in twice}


def test_residue_and_mentions(spark):
    texts = [*FINE, *RESIDUE, *(f"{PROSE[i % len(PROSE)]}\n\n{r}" for i, r in enumerate(RESIDUE))]
    rows = docs(spark, texts * 3)
    got = {r.doc_id % len(texts) for r in residue.found(rows).collect()}
    assert not got & set(range(len(FINE)))
    want = set(range(len(FINE), len(texts)))
    assert len(got & want) >= 0.9 * len(want)


def test_residue_of_no_rows(spark):
    assert residue.found(docs(spark, [])).count() == 0
    assert [(r.chars, r.found) for r in residue.residue_pieces(docs(spark, [None, ""])).collect()] == [(0, 0), (0, 0)]


def test_wrapped_lines_are_joined():
    assert residue.pieces("a line that was broken for its\nwidth and goes on. Next\n\nTitle") == ["a line that was broken for its width and goes on.", "Next", "Title"]
    assert pa is not None
