"""The per-text helpers against plain definitions."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from promolift.llm import chat, html, jaccard, pieces, quality, token_files, tokens

ODD = [
    "", " ", "a", "  two  spaces ", "line\nline", "\n\n lead", "tail \n", "tab\there", "it's they'll\nDon't",
    "日本語 テキスト 😀", "nb space", "x\u0001y \u0001", "<|endoftext|> plain", "é é Σίσυφος ΣΑΣ", "w" * 300,
    "1234 5,678.90%% --- ", "\r\nwindows\r\nlines", "ﬁ ligature ​ zero",
]


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", "kept"), ("word_bpe_49k.json", "dropped")])
def test_encoder_equals_the_library(name, spaces):
    tool = tokens.Encoder(public_tokenizers.path(name), spaces)
    for _ in range(2):  # unknown words first, then known ones
        for texts in (ODD, [" ".join(ODD)] * 2, ["\n".join(ODD)]):
            for text, data in zip(texts, tool.encode(texts), strict=True):
                whole = tool.tokenizer.encode(text, add_special_tokens=False).ids
                assert np.frombuffer(data, tool.dtype).tolist() == whole, text


def test_encoder_forgets_when_full(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 3)
    tool = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), "kept")
    for text in ["one two three", "four five six seven eight", "one nine"]:
        whole = tool.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tool.encode([text])[0], tool.dtype).tolist() == whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=1500), st.integers(0, 41))
def test_wavelet_matrix(values, value):
    array = np.array(values, np.uint16)
    matrix = token_files.WaveletMatrix.from_bytes(token_files.WaveletMatrix.of(array).to_bytes())
    assert matrix.all().tolist() == values
    places = [i for i, x in enumerate(values) if x == value]
    assert matrix.count(value) == len(places)
    assert matrix.occurrences(value)[:50] == places[:50]
    for place in range(0, len(values), 97):
        assert matrix.access(place) == values[place]
        assert matrix.rank(value, place) == sum(x == value for x in values[:place])


def test_token_file_keeps_documents():
    ids = [np.array([5, 2], np.uint16), np.array([2], np.uint16), np.array([70, 9, 9, 2], np.uint16)]
    docs, lengths, matrix = token_files.open_file(token_files.pack_file([None, -3, 8], ids))
    assert (docs, lengths.tolist(), matrix.all().tolist()) == ([None, -3, 8], [2, 1, 4], [5, 2, 2, 70, 9, 9, 2])
    with pytest.raises(ValueError):
        token_files.open_file(b"nonsense")


def best_path(tool, text):
    """Viterbi over the whole text at once."""
    best = [(float("-inf"), 0, 0)] * (len(text) + 1)
    best[0] = (0.0, 0, 0)
    for i in range(len(text)):
        single = False
        for j in range(i + 1, min(len(text), i + tool.longest) + 1):
            if found := tool.pieces.get(text[i:j]):
                single |= j == i + 1
                if best[i][0] + found[1] > best[j][0]:
                    best[j] = (best[i][0] + found[1], i, found[0])
        if not single and best[i][0] + tool.unknown > best[i + 1][0]:
            best[i + 1] = (best[i][0] + tool.unknown, i, pieces.UNKNOWN)
    out, at = [], len(text)
    while at:
        _, start, piece = best[at]
        out.append(tool._bytes_for(text[start:at]) if piece == pieces.UNKNOWN else [piece])
        at = start
    return [i for ids in reversed(out) for i in ids]


@pytest.fixture(scope="module")
def sentence_pieces():
    return pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("text", [*ODD, "▁ mark ▁", "ab " * 700, "z" * 4000])
def test_viterbi_equals_whole_search_and_decodes(sentence_pieces, text):
    tool, marked = sentence_pieces, "▁" + text.replace(" ", "▁")
    ids = tool.encode(text)
    assert tool.decode(ids) == text.replace("▁", " ")
    if text:
        assert np.frombuffer(ids, "<u4").tolist() == best_path(tool, marked)
        parts = [marked[i:i + 5] for i in range(0, len(marked), 5)]
        assert [i for some in tool.search(parts) for i in some] == best_path(tool, marked)


def test_viterbi_commits_early_with_a_small_vocabulary():
    scores = {"a": -1.0, "b": -1.5, "ab": -1.8, "ba": -2.0, "aba": -2.4, "▁": -1.0}
    tool = pieces.Vocabulary({p: (i, s) for i, (p, s) in enumerate(scores.items())}, list(range(10, 266)))
    rng = random.Random(3)
    for _ in range(40):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        found = list(tool.search(iter(text)))
        assert [i for some in found for i in some] == best_path(tool, text)
    assert len(list(tool.search(iter("ab" * 200)))) > 5


def test_long_texts_are_searched_in_parts(sentence_pieces, monkeypatch):
    sizes = []
    search = sentence_pieces.search
    monkeypatch.setattr(sentence_pieces, "search", lambda parts: search(sizes.append(len(p)) or p for p in parts))
    text = "two  spaces and more " * 1000 + "z" * 9000
    ids = sentence_pieces.encode(text)
    assert max(sizes) <= 4096 and sum(sizes) == len(text) + 1
    assert np.frombuffer(ids, "<u4").tolist() == best_path(sentence_pieces, "▁" + text.replace(" ", "▁"))


def plain_measures(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab é#|\n\t "), max_size=200))
def test_measures(text):
    assert quality.measured(text) == plain_measures(text)


def test_measures_of_long_repeats():
    text = "a b c d e f g h i " * 3000
    assert quality.measured(text) == plain_measures(text)
    assert quality.measured(None) == (0, 0, 0, 0, 0)


def test_similar_sets_share_a_signature():
    rng = random.Random(5)
    for percent in (90, 80):
        scheme = jaccard.Scheme(percent, 10**6)
        for _ in range(400):
            n = rng.choice([rng.randint(1, 30), rng.randint(30, 400)])
            one = {rng.getrandbits(64) for _ in range(n)}
            two = set(rng.sample(sorted(one), n - rng.randint(0, n // 8)))
            two |= {rng.getrandbits(64) for _ in range(rng.randint(0, max(1, n // 9)))}
            if one != two and 100 * len(one & two) >= percent * len(one | two):
                signed = [{c: (need, set(s.tolist())) for c, need, s in scheme.signatures(
                    np.array(sorted(x), np.uint64))} for x in (one, two)]
                shared = {c: len(signed[0][c][1] & signed[1][c][1]) for c in signed[0].keys() & signed[1].keys()}
                assert any(n >= max(signed[0][c][0], signed[1][c][0]) for c, n in shared.items())


def test_shingles():
    assert len(jaccard.shingles(None, 3)) == len(jaccard.shingles(" \n", 3)) == 0
    assert len(jaccard.shingles("One two", 3)) == 1
    assert jaccard.shingles("A b\tC d", 3).tolist() == jaccard.shingles("a B c D", 3).tolist()
    assert len(jaccard.shingles("a b c a b c a b c", 3)) == 3
    assert jaccard.shingles("É b c", 3).tolist() != jaccard.shingles("é b c", 3).tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(
    st.text(max_size=5) | st.sampled_from(chat.CONTROLS),
    st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\n", " ", "x", " [SAYS] "]), max_size=8).map("".join)),
    max_size=5))
def test_template_can_be_read_back(turns):
    import re

    def escape(text):
        return re.sub("(" + chat.CONTROL + ")", r"\\\1", text)

    text = "".join(
        f"[TURN] {escape(role)} [SAYS] {escape(said)} " + ("</s>\n" if role == "assistant" else "[/TURN]\n")
        for role, said in turns)
    assert chat.read_turns(text) == turns


@pytest.mark.parametrize("page,expected", [
    (None, []), ("", []), ("plain &amp; text", ["plain & text"]),
    ("<p>a<p>b<b>c</b> d<br>e", ["a", "bc d e"]),
    ("<div>x<script>var a='</p>';</script>y</div>", ["x", "y"]),
    ("a < b <c", ["a < b"]), ("<ul><li>1<li>2</ul>3", ["1", "2", "3"]),
    ("<!-- <p>no --><p title=\"a>b\">yes", ["yes"]), ("<p>&lt;b&gt; &#233;&nbsp; x", ["<b> é x"]),
])
def test_blocks(page, expected):
    assert [text for _, text in html.blocks(page)] == expected


def test_main_text_leaves_out_what_is_no_article():
    page = """<header>Site</header><nav><a>Menu</a></nav><div class="cookie-notice">We use</div>
    <main><article><header><h1>Title</h1></header><p>One</p><aside>Side</aside><form>Mail <input></form>
    <section id="comments"><article class="comment"><p>First!</p></article></section><p>Two</p></article></main>
    <footer>Foot</footer>"""
    found = html.blocks(page)
    text = html.main_text([p for p, _ in found], [t for _, t in found], set())
    assert text == "Title\nOne\nTwo"
    bare = html.blocks("<div class=menu>m</div><div>kept</div>")
    assert html.main_text([p for p, _ in bare], [t for _, t in bare], set()) == "kept"


@pytest.mark.parametrize("page", [
    "<body class='home no-sidebar'><article><p>One two</p></article></body>",
    "<div class='site has-header'><main><p>One two</p></main></div>",
    "<article class='post comments-open'><p>One two</p></article>",
    "<div class='right-sidebar-layout'><p>One two</p></div><div class=sidebar>Side</div>",
    "<div class='has-header'><article><header class='entry-header'>One</header><p>two</p></article></div>",
    "<div class='comments'><article>Said</article></div><article><p>One two</p></article>",
])
def test_names_only_speak_against_small_branches(page):
    found = html.blocks(page)
    text = html.main_text([p for p, _ in found], [t for _, t in found], set())
    assert text.split() == ["One", "two"]


def test_importance_overrules_names():
    found = html.blocks("<div class=promo>One two</div><p>a b c d</p>")
    paths, texts = [p for p, _ in found], [t for _, t in found]
    assert html.main_text(paths, texts, set()) == "a b c d"
    assert html.main_text(paths, texts, set(), {paths[0]}) == "One two\na b c d"


def test_sketches_never_differ_in_more_bits_than_their_sets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 400, 4000):
        common = rng.integers(-2**63, 2**63, 300)
        one, two = (np.concatenate([common, rng.integers(-2**63, 2**63, n)]) for _ in range(2))
        bits = np.bitwise_count((jaccard.sketch_of(one) ^ jaccard.sketch_of(two)).view(np.uint64)).sum()
        assert bits <= 2 * n and (bits >= n / 2 or n > 400)


def test_a_short_text_is_searched_as_a_long_one():
    tool = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("▁", "▁word", "▁ünïcode☃x", "▁" + "ab" * 200, "x\U0001f600y"):
        long = b"".join(np.array(ids, "<u4").tobytes() for ids in tool.search([text]))
        assert tool._searched(text) == long


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "kept")])
def test_plain_words_need_the_merges_alone(name, spaces):
    tool = tokens.Encoder(public_tokenizers.path(name), spaces)
    texts = ["Naïve çà, ÀÉ!! Straße?! a--b <x> d' e''s 'tis foo_bar ÿ~ x²", "Only ASCII words, here; and HERE.\nNew line"]
    expected = [tool._bytes(tool._library(text)) for text in texts]
    assert tool.encode(texts) == expected
    words = ["Lyat,", "çà!!", "HERE"] if spaces == "dropped" else [" Lyat,", " çà!!", " HERE"]
    whole = [tool._bytes(tool._library(word)) for word in words]
    assert tool._separately(tool.merges, tool._as_before_merges, words) == whole


def test_other_steps_before_the_merges_are_left_to_the_library(tmp_path):
    import json
    steps = json.loads(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    steps["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "lower.json"
    path.write_text(json.dumps(steps))
    tool = tokens.Encoder(str(path), "kept")
    assert tool.merges is None
    assert tool.encode(["Some Words, HERE"]) == [tool._bytes(tool._library("some words, here"))]


@pytest.mark.parametrize("path,spaces", [("byte_bpe_50k.json", "kept"), ("word_bpe_49k.json", "dropped")])
def test_words_are_looked_up_once(path, spaces):
    class Counted(dict):
        lookups = 0

        def get(self, key):
            self.lookups += 1
            return super().get(key)

        def __contains__(self, key):
            self.lookups += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            self.lookups += 1
            return super().__getitem__(key)

    encoder = tokens.Encoder(public_tokenizers.path(path), spaces)
    encoder.words = Counted()
    texts = ["some words and some more\nwords again", "and again, words"]
    first = encoder.encode(texts)
    assert encoder.words.lookups == sum(len(text.split()) for text in texts)
    assert encoder.encode(texts) == first and encoder.words.lookups == 2 * sum(len(text.split()) for text in texts)


def test_texts_with_white_space_of_other_kinds_are_encoded_as_a_whole():
    every = [c for c in map(chr, range(0x110000)) if c.isspace()]
    assert sorted([*tokens.OTHER_SPACES, " ", "\n"]) == every
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), "kept")
    texts = [f"{a}one{b}{c}two{d}" for a in ("", " ", "\n") for b in every for c in ("", " ", "\n", "\t") for d in ("", " ", "\n")]
    for text in texts:
        plain = " ".join(text.split()) == text.replace("\n", " ")
        assert (encoder._parts(text) is not None) == plain
    whole = [np.array(encoder._library(text), encoder.dtype).tobytes() for text in texts]
    assert encoder.encode(texts) == whole


WORD_PATH = public_tokenizers.path("word_bpe_49k.json")


def test_different_words_of_all_texts_are_looked_up_once():
    class Counted(dict):
        lookups = 0

        def get(self, key):
            self.lookups += 1
            return super().get(key)

    encoder = tokens.encoder.__wrapped__(WORD_PATH, "dropped")
    encoder.words = Counted()
    texts = ["Some words, and some more\nwords again!", "AND again, words."] * 50
    expected = [encoder._bytes(encoder._library(text)) for text in texts]
    assert encoder.encode(texts) == expected
    # some words , and more again ! .
    assert encoder.words.lookups == 8 == len(encoder.words)
    assert encoder.encode(texts) == expected and encoder.words.lookups == 16


def test_numbered_words_have_the_ids_of_whole_texts():
    own = tokens.NumberedEncoder(WORD_PATH).own_ids
    odd = [
        # Capital letters without a composed form whose small letters have one, and the reverse.
        *(f"{a}{mark}, {a.lower()}{mark}." for a in "JHTWYIKEA" for mark in ("\u030c", "\u0331", "\u0308", "\u030a", "\u0307")),
        *own, *map(str.upper, own), *(f"a{x}b" for x in own), *(f"A{x.upper()},b" for x in own),
        "=\u0338 x=\u0338 <\u0338", "É×, é÷. Ð! ß? ÿ) Ā, ſ. \u212a, \u212b.", "ÀÉ,ç;Ö:", "it's'S'tX, DON'T.", "x,\u0301 y",
        "a,b.c!d 1,2 ,a ..a.. \u00a0a,\u2003b", "w" * 200 + "," + "Ü" * 99, "\x01, \x00.", "\x1ca,\x85b",
    ]
    for tool in (tokens.NumberedEncoder(WORD_PATH) for _ in range(2)):
        for texts in ([], [""], ["", ",", "", "a", ","], [*ODD, *odd], ["".join(odd)], ["!".join([*odd, *ODD])], odd[::-1]):
            assert tool.encode(texts) == [tool._bytes(tool._library(text)) for text in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aJzÉß×é,.!'`~s1 \n\t\x0b\u030c\u0301\u0331\u00a0\x01İΣ中"), max_size=40), max_size=5))
def test_numbered_words_of_any_text(texts):
    tool = tokens.encoder(WORD_PATH, "dropped")
    assert tool.encode(texts) == [tool._bytes(tool._library(text)) for text in texts]


def test_numbered_words_leave_when_too_many_or_too_long(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 3)
    tool = tokens.NumberedEncoder(WORD_PATH)
    for text in ["one two three", "four", "five six seven eight", "one " + "nine" * 30]:
        assert tool.encode([text]) == [tool._bytes(tool._library(text))]
        assert max(map(len, tool.words)) <= tokens.LONGEST_KEPT
        assert len(tool.words) <= 4


def test_numbered_words_need_known_steps(tmp_path):
    import json
    steps = json.loads(open(WORD_PATH).read())
    steps["normalizer"] = {"type": "NFC"}
    path = tmp_path / "capitals.json"
    path.write_text(json.dumps(steps))
    tool = tokens.encoder.__wrapped__(str(path), "dropped")
    texts = ["Some Words, HERE", "J\u030c"]
    assert tool.encode(texts) == [tool._bytes(tool._library(text)) for text in texts]


BYTE_PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_different_spaced_words_of_all_texts_are_looked_up_once():
    class Counted(dict):
        lookups = 0

        def get(self, key):
            self.lookups += 1
            return super().get(key)

    encoder = tokens.encoder.__wrapped__(BYTE_PATH, "kept")
    encoder.words = Counted()
    texts = ["Some words, and some  more\nwords\tagain!", "and again, words."] * 50
    expected = [encoder._bytes(encoder._library(text)) for text in texts]
    assert encoder.encode(texts) == expected
    words = ["Some", " words", ",", " and", " some", " ", " more", "\n", "words", "\t", "again", "!", "and", " again", "."]
    assert sorted(encoder.words) == sorted(word.encode() for word in words)
    assert encoder.words.lookups == len(words)
    assert encoder.encode(texts) == expected and encoder.words.lookups == 2 * len(words)


def test_spaced_words_have_the_ids_of_whole_texts():
    spaces = [" ", "  ", "\n", "\n ", " \n", "\t", " \t ", "\r\n", "\x0b\x0c", "\x1c", "\x85", "\u00a0", "\u2003 "]
    odd = [
        *(f"{a}one{b}two,{c}" for a in ["", *spaces] for b in spaces for c in ["", *spaces]),
        "É×, é÷. Ð! ß? ÿ) Ā, ſ.", "ÀÉ,ç;Ö:", "it's'S'tX, DON'T,'s x''ll,", "x,\u0301 é,", "a,b.c!d 1,2 ,a ..a..", "w" * 200 + ",",
        "a<|endoftext|>b", "<|endoftext|", "\x01, \x00.", "x²½,",
    ]
    for tool in (tokens.encoder.__wrapped__(BYTE_PATH, "kept") for _ in range(2)):
        for texts in ([], [""], ["", ",", "", "a", ","], [*ODD, *odd], ["".join(odd)], ["!".join([*odd, *ODD])], odd[::-1]):
            assert tool.encode(texts) == [tool._bytes(tool._library(text)) for text in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aJstléß×é,.!'`~1 \n\t\r\x0b\u0301\u00a0\x1c\x01İΣ中"), max_size=40), max_size=5))
def test_spaced_words_of_any_text(texts):
    tool = tokens.encoder(BYTE_PATH, "kept")
    assert tool.encode(texts) == [tool._bytes(tool._library(text)) for text in texts]


def test_spaced_words_leave_when_too_many_or_too_long(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 3)
    tool = tokens.encoder.__wrapped__(BYTE_PATH, "kept")
    for text in ["one two three", "four", "five six seven eight", "one " + "nine" * 30]:
        assert tool.encode([text]) == [tool._bytes(tool._library(text))]
        assert max(map(len, tool.words)) <= tokens.LONGEST_KEPT
        assert len(tool.words) <= 4


def test_spaced_words_need_known_steps(tmp_path):
    import json
    steps = json.loads(open(BYTE_PATH).read())
    steps["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "lower.json"
    path.write_text(json.dumps(steps))
    tool = tokens.encoder.__wrapped__(str(path), "kept")
    texts = ["Some Words, HERE", "two  spaces"]
    assert tool.encode(texts) == [tool._bytes(tool._library(text)) for text in texts]
