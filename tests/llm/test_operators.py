"""The operators on small tables against brute force, with the awkward rows in them."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from promolift.llm import chat, html, jaccard, sharding, token_files
from promolift.llm.exact_dedup import drop_copies, exact_dedup
from promolift.llm.jaccard import drop_near_copies, jaccard_classes
from promolift.llm.line_dedup import line_dedup
from promolift.llm.packing import pack
from promolift.llm.pieces import decode_texts, encode_texts
from promolift.llm.quality import keep_good, quality
from promolift.llm.token_files import placed, read_files, write_files

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` int, whole string, h1 int, sha string"


def make_rows():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " ", "one", "One two", "x" * 3000, "a\n\nb\n", "### $$$ " * 40]
    base = sentence(120)
    texts += [base] * 25  # a hot group of copies
    for _ in range(30):  # near copies of one text
        changed = base.split()
        for _ in range(rng.choice([1, 2, 4, 9])):
            changed[rng.randrange(len(changed))] = f"n{rng.random()}"
        texts.append(" ".join(changed))
    shared = "This line is in many documents, again"
    texts += [f"{sentence(30)}\n {shared} \n{sentence(5)}\n{shared.upper()}" for _ in range(12)]
    texts += [sentence(rng.randint(1, 60)) for _ in range(60)]
    texts += [sentence(4000)]
    rows = [(i * 3 - 5, t, rng.choice(["en", "de", None]), "hot" if i % 3 == 0 else rng.choice(["a", "b", None]),
             len(t or ""), 1, "clash", 2, "s") for i, t in enumerate(texts)]
    rows += [rows[20], rows[0]]  # repeated rows
    return rows


ROWS = make_rows()
NAMED = ROWS + [(None, base, "en", "a", 1, 1, "c", 2, "s") for base in (ROWS[10][1], "nobody else has this text")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(NAMED, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for row in NAMED:
        groups[normal(row[1])].append(row[0])
    got = exact_dedup(docs).collect()
    assert len(got) == len(NAMED)
    named = lambda ids: [i for i in ids if i is not None]
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min(named(ids), default=None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_tree_merge_of_many_runs(spark):
    rows = [(i, f"t{i % 7}") for i in range(400)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(60)).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {
        (k, sum(i % 7 == k for i in range(400))) for k in range(7)}


def test_quality(docs):
    from tests.llm.test_text_helpers import plain_measures

    got = {r.doc_id: r for r in quality(docs).collect() if r.doc_id is not None}
    for row in ROWS:
        r, m = got[row[0]], plain_measures(row[1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0])
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in got.values()) > 50
    assert not got[16].kept  # nothing but symbols


def ordinary(rng, n):
    """Lines of ten words of four or five letters, none repeated."""
    return "\n".join(" ".join(f"w{rng.randrange(10**3, 10**4)}" for _ in range(10)) for _ in range(n))


def test_each_working_measure_rejects_a_planted_row(spark):
    rng = random.Random(2)
    rows = [(i, ordinary(rng, 12), "en", "a") for i in range(60)]
    passage = ordinary(rng, 1)
    planted = {
        # Half of the lines are one line of seven words, so no eight words repeat.
        "dup_lines": "\n".join(x for _ in range(12) for x in (" ".join(passage.split()[:7]), ordinary(rng, 1))),
        # A fourth of the words are in repeated windows, inside lines that differ.
        "repeats": "\n".join([f"{passage} {ordinary(rng, 1)}" for _ in range(3)] + [ordinary(rng, 6)]),
        "short": " ".join(rng.choice("abcdefghijklm") for _ in range(60)),
        "long": ordinary(rng, 12).replace("w", "w" * 8),
        "symbols": ordinary(rng, 12).replace(" ", " # "),
    }
    rows += [(100 + i, text, "en", "a") for i, text in enumerate(planted.values())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert not any(r.base_failed for r in quality(docs).collect())
    assert sorted(r.doc_id for r in keep_good(docs).collect()) == list(range(60))


def test_words_of_text_without_spaces_can_be_too_long(spark):
    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choices("天地玄黄宇宙洪荒", k=60 + n % 5)) for n in range(25))
    rows = [(i, line(), "zh", "a") for i in range(60)]
    rows.append((100, f"{line()} {'字' * 100_000}", "zh", "a"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert sorted(r.doc_id for r in keep_good(docs).collect()) == list(range(60))


def test_line_dedup(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(
        {c: c + 32 for c in range(65, 91)})
    holders = defaultdict(list)
    for row in NAMED:
        for k in {key(x) for x in (row[1] or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(row[0])
    expected = Counter()
    for row in NAMED:
        kept = []
        lines = (row[1] or "").split("\n")
        for line in lines:
            ids = holders.get(key(line), [])
            if len(ids) < 3 or row[0] == max((i for i in ids if i is not None), default=None):
                kept.append(line)
        expected[(row[0], len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    for batches in (8, 3):
        got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(docs, batches).collect())
        assert got == expected


@pytest.mark.parametrize("shards", [4, 40])
def test_sharding(docs, shards):
    got = sharding.shard_documents(docs, shards).collect()
    assert len(got) == len(NAMED)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min([counts.get(s, 0) for s in range(shards)]) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    texts = Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    assert texts == Counter((x[0], len((x[1] or "").encode()) + 16, zlib.crc32((x[1] or "").encode())) for x in NAMED)
    groups, sizes = defaultdict(set), Counter()
    for r in got:
        groups[r.size, r.text_crc32].add(r.shard)
        sizes[r.size, r.text_crc32] += 1
    cut, links = sum(len(g) - 1 for g in groups.values()), sum(n - 1 for n in sizes.values())
    room = -(-len(NAMED) // shards)
    least = sum(-(-n // room) - 1 for n in sizes.values())
    assert cut <= least + links // 4


def shards_of(spark, groups, shards):
    rows = spark.createDataFrame([(i, g, 0) for i, g in enumerate(groups)], "`row` bigint, g1 bigint, g2 bigint")
    got = sharding.label_propagation(rows, shards).collect()
    assert sorted(r.row for r in got) == list(range(len(groups)))
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    found = defaultdict(set)
    for r in got:
        found[groups[r.row]].add(r.shard)
    return found


def test_a_group_of_many_shards_lies_on_as_few_as_it_needs(spark):
    # A third of all rows: 12000 rows on 40 shards of 300 need 14 shards for 4000.
    found = shards_of(spark, [0] * 4000 + list(range(1, 8001)), 40)
    assert len(found[0]) == 14


def test_a_table_united_with_itself_moves_too(spark):
    found = shards_of(spark, [i // 2 for i in range(1600)], 4)
    assert sum(len(x) > 1 for x in found.values()) <= 20  # three of four pairs are cut at the start


def test_a_large_group_among_linked_documents(spark):
    mixed = shards_of(spark, [0] * 2500 + [1 + i // 2 for i in range(5500)], 8)
    assert len(mixed[0]) <= 4 and sum(len(x) > 1 for x in mixed.values()) <= 60


def brute_classes(rows, width, percent):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc] = {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    label = {doc: doc for doc in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                label[high] = low
    return {doc: (len(s), find(doc)) for doc, s in sets.items()}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_join(docs, width, percent):
    expected = brute_classes([r[:2] for r in ROWS], width, percent)
    got = jaccard_classes(docs, width, percent).collect()
    assert len(got) == len(NAMED)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == sorted(
        ["None", str(expected[ROWS[10][0]][1])])


def test_jaccard_join_of_near_copies_around_the_limit(spark):
    """Members far from their leader but near each other are found through their differences."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for family in range(12):
        moved = dict(base=rng.sample(range(200), 5 + family % 4))
        for _ in range(6):
            words = list(base)
            for place in moved["base"]:
                words[place] = f"f{family}_{place}"
            for place in rng.sample(range(200), rng.choice([0, 1, 2])):
                words[place] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    expected = brute_classes(rows, 3, 90)
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert 1 < len({c for _, c in expected.values()}) < 60


def test_links_are_named_as_what_they_count(docs):
    assert jaccard_classes(docs, 3, 90).columns == ["doc_id", "n_shingles", "component_id", "n_connecting_links"]


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(BYTES)
    ids = {r[0]: np.array([*tool.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in ROWS}
    for weights in (None, {"hot": 3.0, "a": 1.0}):
        got = pack(docs, BYTES, "kept", 1, weights, sequence=64, window=4, chunk=16).collect()
        sequences, pieces = defaultdict(list), defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.offset, r.length))
            pieces[r.doc_id].append(r)
        fills = []
        for number in sorted(sequences):
            at = 0
            for offset, length in sorted(sequences[number]):
                assert offset == at
                at += length
            fills.append(at)
        assert sorted(sequences) == list(range(len(fills))) and set(fills[:-1]) == {64}
        repeats = Counter(r[0] for r in ROWS)
        for doc, whole in ids.items():
            starts = Counter()
            for p in pieces[doc]:
                assert p.ids == whole[p.start:p.start + p.length].tobytes() and p.doc_tokens == len(whole)
                starts[p.start] += p.length
            assert sum(starts.values()) == len(whole) * repeats[doc]
    # Every window but the last few holds the sources in the shares of the corpus.
    share = defaultdict(Counter)
    for r in pack(docs, BYTES, "kept", 1, None, sequence=64, window=8, chunk=16).collect():
        share[r.sequence_id // 8][r.source] += r.length
    total = sum((c for c in share.values()), Counter())
    for window in list(sorted(share))[:-2]:
        for source, n in total.items():
            assert abs(share[window][source] - 512 * n / total.total()) <= 64


def test_token_files(docs):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(WORDS)
    files = write_files(docs, WORDS, "dropped", 2, block_tokens=500)
    got = placed(read_files(files), files).orderBy("start").collect()
    at = 0
    text_of = {r[0]: r[1] for r in ROWS}
    assert [r.doc_id for r in got] == sorted((r[0] for r in NAMED), key=lambda i: (i is not None, i))
    for r in got:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None:
            ids = [*tool.encode(text_of[r.doc_id] or "", add_special_tokens=False).ids, 2]
            assert r.ids == np.array(ids, "<u4").tobytes() and r.n_tokens == len(ids)
    assert files.count() > 3


def test_pieces(docs):
    got = decode_texts(encode_texts(docs, PIECES), PIECES).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1] or "") for r in NAMED)


TREE = [
    (1, 1, None, "user", "root", None), (1, 2, 1, "assistant", "good </s>", 2.0), (1, 3, 1, "assistant", "bad", -1.0),
    (1, 4, 2, "user", "more\\", 0.0), (1, 5, 3, None, None, 9.0), (2, 1, 7, "user", "orphan", 0.0),
    (3, 1, 2, "user", "circle", 0.0), (3, 2, 1, "user", "circle", 0.0), (4, 9, None, "assistant", "[INST]", 1.0),
]


def test_reply_trees(spark):
    messages = spark.createDataFrame(
        TREE, "conv_id bigint, msg_id bigint, parent_id bigint, role string, text string, score double")
    got = {(r.conv_id, r.branch): r for r in chat.format_trees(messages).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (3, 1), (4, 1)}
    first, second = got[1, 1], got[1, 2]
    assert (first.leaf, second.leaf) == (5, 4)
    assert chat.read_turns(first.formatted) == [("user", "root"), ("assistant", "bad"), ("", "")]
    assert chat.read_turns(second.formatted) == [("user", "root"), ("assistant", "good </s>"), ("user", "more\\")]
    loss = [second.formatted[s.start:s.end] for s in second.loss_spans]
    assert [chat.unescaped(x) for x in loss] == ["good </s>"]
    best = chat.format_trees(messages, most_branches=1)
    assert {(r.conv_id, r.leaf) for r in best.collect()} == {(1, 5), (2, 1), (3, 2), (4, 9)}


def test_circles_repeats_and_ties(spark):
    rows = [(1, i, i - 1 if i else 5, "user", f"r{i}", 1.0) for i in range(6)]    # a ring of six
    rows += [(1, 9, 3, "assistant", "hangs", 1.0), (1, -7, 9, "user", "below", 1.0)]
    rows += [(2, 4, 4, "user", "itself", 0.0)]
    rows += [(3, i, i - 1 if i else None, "user", f"c{i}", 0.0) for i in range(5)]
    rows += [(3, 2, 1, "user", "c2", 0.0), (3, 2, 0, "user", "first", 0.0)]       # one name, three rows
    rows += [(4, 1, None, "user", "a", 0.0), (4, 3, 1, "user", "x", 1.0), (4, 2, 1, "user", "y", 1.0)]
    messages = spark.createDataFrame(
        [(*r, 0, "clash") for r in rows],
        "conv_id bigint, msg_id bigint, parent_id bigint, role string, text string, score double, branch int, up string")
    got = Counter(
        (r.conv_id, r.leaf, " ".join(text for _, text in chat.read_turns(r.formatted)))
        for r in chat.format_trees(messages).collect())
    assert got == Counter([
        (1, 5, "r0 r1 r2 r3 r4 r5"), (1, -7, "r0 r1 r2 r3 hangs below"), (2, 4, "itself"),
        # The first of the three by parent is replied to, the others are leaves.
        (3, 4, "c0 first c3 c4"), (3, 2, "c0 c1 c2"), (3, 2, "c0 c1 c2"),
        (4, 2, "a y"), (4, 3, "a x")])
    best = chat.format_trees(messages.where("conv_id = 4"), most_branches=1).collect()
    assert [r.leaf for r in best] == [2]    # equal scores: the smaller leaf


def test_messages_without_ids_are_kept(spark):
    rows = [(None, 1, None, "user", "a", 0.0), (None, 2, 1, "assistant", "b", 0.0),
            (5, None, None, "user", "c", 1.0), (5, None, None, "user", "d", 0.0), (5, 1, None, "user", "e", 2.0)]
    got = chat.format_trees(spark.createDataFrame(
        rows, "conv_id bigint, msg_id bigint, parent_id bigint, role string, text string, score double")).collect()
    assert Counter((r.conv_id, r.leaf, r.branch, tuple(t for _, t in chat.read_turns(r.formatted))) for r in got) == Counter([
        (None, 2, 1, ("a", "b")), (5, 1, 1, ("e",)), (5, None, 2, ("c",)), (5, None, 3, ("d",))])
    turns = spark.createDataFrame(
        [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "user", "z")],
        "conv_id bigint, turn bigint, role string, text string")
    digests = chat.digests(chat.format_trees(chat.as_trees(turns), most_branches=1)).collect()
    assert {r.conv_id: r.n_turns for r in digests} == {None: 2, 3: 1}


def test_deep_and_wide_trees(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(150)]
    rows += [(2, i, (i - 1) // 2 if i else None, "user", str(i), float(i % 5)) for i in range(40)]
    messages = spark.createDataFrame(
        rows, "conv_id bigint, msg_id bigint, parent_id bigint, role string, text string, score double")
    got = chat.format_trees(messages).collect()
    up = {(r[0], r[1]): r[2] for r in rows}
    for r in got:
        path, node = [], r.leaf
        while node is not None:
            path.append(str(node))
            node = up[r.conv_id, node]
        assert [text for _, text in chat.read_turns(r.formatted)] == path[::-1]
    assert Counter(r.conv_id for r in got) == {1: 1, 2: 20}


def test_style_tree_cuts_what_a_host_repeats(spark):
    page = "<div><div class=top>Welcome to us</div><div class=body><p>{0}</p><p>Same end</p></div></div>"
    rows = [(i, f"http://h.example/{i}", page.format(f"Text {i}")) for i in range(12)]
    rows += [(100 + i, f"http://copies.example/{i}", page.format("All alike")) for i in range(12)]
    rows += [(200, None, None), (201, "", ""), (202, "no host", "<p>x"), (None, "http://h.example/9", page.format("Z"))]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(
        rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "Text 3\nSame end" and got[None].text == "Z\nSame end"
    assert got[103].text == "Welcome to us\nAll alike\nSame end"  # copies of one page are one page
    assert (got[200].text, got[201].text, got[202].text) == ("", "", "x")
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_style_tree_cuts_menus_that_differ_a_little(spark):
    """No article element; the menu leaves out one page and marks another."""
    def page(i):
        items = [f"<li{' class=current' if n == i else ''}><a href=/{n}>Item {n}</a></li>"
                 for n in range(12) if n != (i + 1) % 12]
        odd = "<p>Rare</p>" if i == 5 else ""
        return f"<div class=left><ul>{''.join(items)}</ul>{odd}</div><div class=body><p>Story number {i}</p></div>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(12)]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Story number {i}" for i in range(12)}


def test_stages_return_the_columns_of_documents(docs, empty):
    for stage in (keep_good, drop_copies, drop_near_copies):
        kept = stage(docs)
        assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
        assert 0 < kept.count() <= len(NAMED)
        assert stage(empty).count() == 0 and stage(empty).columns == docs.columns


def test_near_copies_keep_one_of_each_class(docs):
    expected = brute_classes([r[:2] for r in ROWS], 5, 80)
    kept = {r.doc_id for r in drop_near_copies(docs).collect() if r.doc_id is not None}
    assert kept == {c for _, c in expected.values()}


def test_empty_tables(spark, empty):
    for run in (
        exact_dedup, quality, line_dedup, sharding.shard_documents, jaccard_classes,
        lambda d: pack(d, BYTES, "kept", 1), lambda d: encode_texts(d, PIECES),
        lambda d: read_files(write_files(d, WORDS, "dropped", 2)),
    ):
        assert run(empty).collect() == []
    messages = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_trees(chat.as_trees(messages)).collect() == []
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_wavelet_file_is_read_without_unpacking(docs):
    files = write_files(docs, WORDS, "dropped", 2)
    for row in files.collect():
        docs_in, lengths, matrix = token_files.open_file(bytes(row.file))
        assert matrix.count(2) >= len(docs_in) == row.n_docs and lengths.sum() == row.n_tokens == matrix.size
        assert matrix.access(int(lengths[0]) - 1) == 2


def test_lists_of_one_set_leave_before_the_rounds(spark):
    alone = [(1, 1000 + i, i) for i in range(2000)]
    lists = [(1, 7, i) for i in range(50)] + [(2, 7, 3), (2, 8, 3), (2, 8, 4)]
    posts = spark.createDataFrame(alone + lists, "leader long, element long, member long")
    left = {(r.leader, r.element, r.member) for r in jaccard.in_company(posts).collect()}
    assert {row for row in lists if row[:2] != (2, 7)} <= left
    # Only the ends of tasks may stay alone.
    assert len(left) <= 52 + 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_keys_of_lines_before_a_separator_of_other_kind(spark):
    from promolift.llm.line_dedup import LEAST_CHARS, line_dedup
    line = "ÀB line that is long enough to count" + "x" * LEAST_CHARS
    # A line separator is no white space here: what stands before it belongs to the key.
    rows = [(1, line + " \u2028"), (2, line + " \u2028"), (3, line + "\u2028"), (4, " " + line.replace("AB", "ab") + " \u2028\t")]
    got = {r.doc_id: r.n_dropped for r in line_dedup(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_sets_without_a_partner_leave_their_lists(spark):
    """Also where lists go on over batches and tasks: whoever has a partner stays."""
    def pairable(one, two):
        return (one.component != two.component and (one.asks and two.answers or one.answers and two.asks)
                and one.d <= two.reach and two.d <= one.reach)

    rng = random.Random(5)
    names = "leader long, element long, member long, d int, reach long, component long, asks boolean, answers boolean"
    rows = []
    for element, size in enumerate([*(rng.randint(1, 9) for _ in range(600)), 700]):
        for member in range(size):
            d = rng.randint(1, 60)
            rows.append((element % 2, element, member, d, d + rng.randint(-25, 4), rng.randint(1, 3),
                         rng.random() < 0.5, rng.random() < 0.5))
    posts = spark.createDataFrame(rows, names)
    lists = {}
    for row in posts.collect():
        lists.setdefault((row.leader, row.element), []).append(row)
    wanted = {(r.leader, r.element, r.member) for rows in lists.values() for r in rows if any(pairable(r, s) for s in rows)}
    assert 0 < len(wanted) < len(rows) / 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        left = [(r.leader, r.element, r.member) for r in jaccard.in_company(posts, pairable=True).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert wanted <= set(left) and len(left) == len(set(left))
    small = {row for row in left if row[1] < 600}
    # Only the lists at the ends of tasks stay whole.
    assert len(small - wanted) <= 9 * 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    one_task = jaccard.in_company(posts.where("leader = 0").coalesce(1), pairable=True)
    assert wanted & {(0, e, m) for _, e, m in left} <= {(r.leader, r.element, r.member) for r in one_task.collect()}


def test_few_rows_of_lists_go_through_the_rounds(spark):
    """Sets that share much with one leader, mostly too little with each other: all similar pairs are found."""
    rng = random.Random(3)
    whole, sets = frozenset(range(100)), []
    for _ in range(60):
        # Some of the leader's shingles give way to those of another set or to new ones.
        gone = rng.sample(range(100), rng.randint(8, 30))
        new = {1000 * rng.randrange(3) + x if rng.random() < 0.7 else rng.randrange(10**4, 10**9) for x in gone}
        sets.append(whole - set(gone) | new)
    sets += [s - {min(s)} | {10**9 + i} for i, s in enumerate(sets[:20])]

    def alike(one, two):
        return 100 * len(one & two) >= 80 * len(one | two)

    stars = [(0, i + 1, len(s), 100, alike(s, whole), sorted(s ^ whole)) for i, s in enumerate(sets)]
    posts = jaccard.postings(
        spark.createDataFrame(stars, "leader long, member long, member_n long, leader_n long, linked boolean, "
                                     "differences array<long>"),
        spark.createDataFrame([], "rep long, component long"), 80).localCheckpoint()
    kept = jaccard.in_company(posts, pairable=True)
    similar = {(x, y) for x in range(1, 81) for y in range(x + 1, 81)
               if not (stars[x - 1][4] and stars[y - 1][4]) and alike(sets[x - 1], sets[y - 1])}
    found = {(min(r.x, r.y), max(r.x, r.y)) for r in jaccard.pairs_across(kept, 80).collect()}
    assert len(similar) >= 10 and similar <= found
    assert 4 * kept.count() < 3 * jaccard.in_company(posts).count()
