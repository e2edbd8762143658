import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanvec.llm import decontaminate as dc
from spanvec.llm import licenses as lc
from spanvec.llm import packing as pk
from spanvec.llm import token_files as tf
from spanvec.llm.tokens import encoder

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string"
ODD = [
    (1, None), (2, ""), (3, "   \n "), (None, "one two three"), (5, "A b c d e f g h i j K l é"), (5, "A b c d e f g h i j K l é"),
    (6, "x " * 3000 + "a-b-c d e f g h i j!"), (7, "Short item. Released undr the MIT Licence; GNU general public\nlicense CC-BY cc by"),
    (8, "z\x00 \t\x1c\x85 q  double  space\n\nnew \n line <|endoftext|> It's 12 déjà"), (9, " lead and trail \n"), (10, "日本語 テスト　です áe"),
]


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in ODD], DOCS)


def test_decontaminate_is_brute_force(spark, docs):
    bench = [(1, "a b c d e f g h i j k"), (2, "short ITEM"), (10, "short item"), (3, None), (None, "double space"), (4, "!!")]
    got = dc.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string"), spans=True).collect()
    assert len(got) == len(ODD)
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, []).append(r)
    for i, t in ODD:
        w, hit, items = words(t), set(), set()
        for item, b in bench:
            v = words(b)
            for k in range(max(1, len(v) - 9) if v else 0):
                g = v[k : k + 10]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        items |= {str(item)} if item is not None else set()
        r = texts[i][0]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit)), i
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        for s in r.spans:
            assert " ".join(words(t[s.start : s.stop])) in {" ".join(words(b)) for _, b in bench} | {"a b c d e f g h i j", "b c d e f g h i j k"}
    many = dc.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string"), automaton_bytes=70).drop("spans")
    assert sorted(map(str, many.collect())) == sorted(str(r) for r in dc.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string")).collect())
    assert {r.doc_id for r in dc.clean(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()} == {r.doc_id for r in got if not r.contaminated}
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in dc.decontaminate(docs, none).collect())
    assert dc.decontaminate(docs.limit(0), none).count() == 0


def test_long_texts_are_scanned_and_packed_whole():
    item = "one two three four five six seven eight nine ten eleven"
    w = dc.Windows([("a", item.encode()), ("b", b"short note")], 10)
    plain = "one two three short four note five " * 40_000
    for where in (0, 500_000, len(plain)):
        text = f"{plain[:where]} x {item.upper()}, short-note! {plain[where:]}".encode()
        size, _, first, state = w.scan([b"", text, b"short"])
        at = len(words(plain[:where])) + 1
        assert size.tolist() == [0, len(words(text.decode())), 1]
        assert sorted(zip(first.tolist(), w.items_of(state))) == [(at, ("a",)), (at + 1, ("a",)), (at + 11, ("b",))]
    path = public_tokenizers.path(pk.TOKENIZER)
    tok, enc = Tokenizer.from_file(path), encoder(path, "space")
    text = "Né wörd, of \n\n many. 日本 " * 8000
    ids = tok.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == ids and sum(pk.lengths(len(ids))) == len(ids) > 100_000


def test_licenses(docs):
    got = {r.doc_id: r for r in lc.scan_licenses(docs, spans=True).collect()}
    for i, t in ODD:
        w, at, labels = words(t), [], set()
        for p, lab in lc.PHRASES:
            v = p.split()
            own = [k for k in range(len(w)) if w[k : k + len(v)] == v]
            at += own
            labels |= {lab} if own else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[7].labels == "cc-by,gpl,mit" and got[7].n_fuzzy
    s = got[7].spans[0]
    assert words(ODD[7][1])[s.start_word : s.stop_word] == "released undr the mit licence".split() and s.label == "mit"


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_seeds_lose_no_edited_notice(data):
    scanner = lc.Scanner()
    i = data.draw(st.integers(0, len(scanner.notices) - 1))
    n = list(scanner.notices[i][0])
    for _ in range(data.draw(st.integers(0, scanner.k[i]))):
        p = data.draw(st.integers(1, max(1, len(n) - 2)))
        kind = data.draw(st.sampled_from("sid"))
        n[p : p + (kind != "i")] = [] if kind == "d" else [data.draw(st.sampled_from("abcxyz"))]
    text = "foo bar " + "".join(n) + " baz"
    norm = " " + " ".join(words(text)) + " "
    brute = scanner.patterns[i].search(norm)
    brute = brute and scanner.named(norm, i, brute.start(), brute.end())
    found = [m for m in scanner.scan(text.encode())[2] if m[2] == scanner.notices[i][1]]
    assert bool(brute) <= bool(found)
    assert regex.search("foo", text)


def apart(pattern, text, lo, hi):
    """Of the whole range the best match, then those before and behind it."""
    m = pattern.search(text, lo, hi)
    return [*apart(pattern, text, lo, m.start()), (m.start(), m.end(), sum(m.fuzzy_counts)), *apart(pattern, text, m.end(), hi)] if m else []


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_notices_side_by_side_are_brute_force(data):
    scanner = lc.Scanner()
    i = data.draw(st.integers(0, len(scanner.notices) - 1))
    text = ""
    for _ in range(data.draw(st.integers(1, 6))):
        n = list(scanner.notices[i][0])
        for _ in range(data.draw(st.integers(0, scanner.k[i] + 1))):
            p = data.draw(st.integers(0, len(n) - 1))
            kind = data.draw(st.sampled_from("sid"))
            n[p : p + (kind != "i")] = [] if kind == "d" else [data.draw(st.sampled_from("abcxyz "))]
        text += "".join(n) + data.draw(st.sampled_from(["", " ", " by acme "]))
    norm = " " + " ".join(words(text)) + " "
    one = lc.Scanner(phrases=(("foo", "foo"),), notices=(scanner.notices[i],))
    assert [(a, b, e) for a, b, _, e, _ in one.scan(text.encode())[2]] == [m for m in apart(one.patterns[0], norm, 0, len(norm)) if one.named(norm, 0, m[0], m[1])]


def test_an_edit_is_of_a_character(spark):
    texts = ["Über 日本: all rights resérved", "x é released under the “mit” license 😀 all rights re😀served, Apache License", "é all r\u0301íghts reserved"]
    rows = lc.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spans=True).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["reserved", "apache,mit,reserved", ""]
    assert [(r.first_word, r.n_base) for r in rows] == [(None, 0), (11, 1), (None, 0)]
    spans = [sorted((s.label, " ".join(words(t)[s.start_word : s.stop_word]), s.edits) for s in r.spans) for r, t in zip(rows, texts)]
    assert spans[0] == [("reserved", "all rights resérved", 1)]
    assert spans[1] == [("mit", "released under the “mit” license", 2), ("reserved", "all rights re😀served", 1)]
    assert lc.Scanner().scan(b"\xff\xe9 all rights res\xe9rved")[2][0][2:4] == ("reserved", 1)


def test_another_license_is_not_an_edit():
    labels = lambda t: {m[2] for m in lc.Scanner().scan(t.encode())[2]}
    for name in ("MPL", "BSD", "ISC", "GPL", "MIT"):
        assert labels(f"Released under the {name} license.") == labels(f"relased under the {name} licence") == {name.lower()}
    assert labels("released under the zlib license") == labels("released under the miit license") == set()
    assert labels("Licensed under the Apach License, Version 2.0") == labels("Licensed under the Apache Licence, Vrsion 2.0") == {"apache"}
    assert labels("licensed under the new general public license") == set() and labels("GNU Affero General Public Licence") == {"agpl"}


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=9), st.text("abcd ", max_size=25), st.integers(0, 4))
def test_bit_parallel_edits(pattern, text, k):
    masks = {c: sum(1 << x for x, y in enumerate(pattern) if y == c) for c in set(pattern)}
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for x, y in enumerate(pattern):
            new.append(min(new[-1] + 1, row[x + 1] + 1, row[x] + (c != y)))
        row, best = new, min(best, new[-1])
    assert lc.least_edits(masks, len(pattern), text) == best


def test_a_long_text_of_notices_takes_seconds():
    import time

    scanner = lc.Scanner()
    for unit in ("all rights reserve ", "all rights reserved ", "permission is hereby granted free of charge to any person obtaining a copy "):
        began = time.process_time()
        found = scanner.scan((unit * (150_000 // len(unit))).encode())[2]
        assert len(found) == 150_000 // len(unit) and time.process_time() - began < 3


def test_no_notice_is_lost_before_a_better_one():
    found = lc.Scanner().scan(("all right reserved " * 10 + "all rights reserved").encode())[2]
    assert [e for *_, e, _ in found] == [1] * 10 + [0]


@pytest.mark.parametrize("name,mode", [(tf.TOKENIZER, "drop"), (pk.TOKENIZER, "space")])
def test_cached_parts_give_the_ids_of_whole_texts(name, mode):
    path = public_tokenizers.path(name)
    tok, enc = Tokenizer.from_file(path), encoder(path, mode)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.sampled_from(list("aÉ,..B_*%5²'st1 .,\n\t-é́　\x85\x1c\x00ß#<|>日Σ")), max_size=40))
    def same(t):
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids

    same()
    for _, t in ODD:
        assert np.frombuffer(enc.encode(t or ""), enc.dtype).tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_packing(docs):
    tok = Tokenizer.from_file(public_tokenizers.path(pk.TOKENIZER))
    got = pk.pack(docs, public_tokenizers.path(pk.TOKENIZER), tokens=True).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    for i, t in ODD:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        rows = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        rows = rows[:: 2 if i == 5 else 1]
        assert sum((r.ids for r in rows), []) == ids
        for r in rows:
            assert r.length & (r.length - 1) == 0 and r.length <= 1024 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    in_order = [(-r.length, r.doc_id or -1, r.start) for r in sorted(got, key=lambda r: r.sequence_id)]
    assert in_order == sorted(in_order)
    again = pk.pack(docs.repartition(5), public_tokenizers.path(pk.TOKENIZER)).drop("ids")
    assert sorted(map(str, again.collect())) == sorted(str(r) for r in pk.pack(docs.coalesce(1), public_tokenizers.path(pk.TOKENIZER)).collect())
    assert pk.lengths(2053) == [1024, 1024, 4, 1] and pk.lengths(1) == [1] and sum(pk.lengths(777)) == 777
    with pytest.raises(ValueError):
        pk.pack(docs, "x", longest=1000)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_codes_round_trip(ids):
    a = np.array(ids, np.uint32)
    f = tf.TokenFile(b"".join(tf.file_bytes(np.array([3]), np.array([False]), np.array([len(a)]), a)))
    assert f.all().tolist() == ids and f.docs["n"].tolist() == [len(ids)]
    for i in range(0, len(ids), 7):
        assert f.token(i) == ids[i]
    for i in range(0, len(ids) + 1, 61):
        for j in {i, min(i + 1, len(ids)), min(i + 64, len(ids)), min(i + 613, len(ids)), len(ids)}:
            assert f.ids(i, j).tolist() == ids[i:j]
    assert f.document(0).tolist() == ids
    with pytest.raises(IndexError):
        f.token(len(ids))


def test_token_files(spark, docs, tmp_path):
    path = public_tokenizers.path(tf.TOKENIZER)
    tok = Tokenizer.from_file(path)
    man = tf.write_token_files(docs, path, f"file://{tmp_path}/t", file_text_bytes=900)
    assert man.count() > 2
    got = tf.read_token_files(man, f"file://{tmp_path}/t").collect()
    at = 0
    for i, t in sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        r = next(r for r in got if (r.doc_id, r.start) == (i, at))
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(ODD)
    empty = tf.write_token_files(docs.limit(0), path, f"file://{tmp_path}/e")
    assert tf.read_token_files(empty, f"file://{tmp_path}/e").count() == 0


def test_a_hot_id_fills_several_files(spark, tmp_path):
    path = public_tokenizers.path(tf.TOKENIZER)
    tok = Tokenizer.from_file(path)
    rows = [(None, f"none {k}") for k in range(300)] + [(5, f"five {k}") for k in range(300)] + [(5, "same")] * 300 + [(9, "é " * 20_000)] + [(k, f"other {k}") for k in range(10, 60)]
    man = tf.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), path, f"file://{tmp_path}/t", file_text_bytes=500)
    files = man.collect()
    assert len(files) > 12 and max(f.n_docs for f in files) < 200
    got = sorted(tf.read_token_files(man, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    crc = lambda t: zlib.crc32(np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in got) == sorted((i or 0, crc(t)) for i, t in rows)


@pytest.mark.parametrize("name,mode", [(tf.TOKENIZER, "drop"), (pk.TOKENIZER, "space")])
def test_ids_of_every_letter_and_of_any_text(name, mode):
    path = public_tokenizers.path(name)
    tok, enc = Tokenizer.from_file(path), encoder(path, mode)
    every = [chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["ALİ. KADİ, ", *(f"ab{c}. x{c}, y" for c in every if c.isalnum() or ord(c) < 0x3000)]
    for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == e.ids, hex(ord(t[2]))

    @settings(max_examples=500, deadline=None)
    @given(st.lists(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from([" ", ". ", ", ", "İ", "\u0338", "\u0307", "a", "="])), max_size=30).map("".join))
    def same(t):
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids

    same()


@pytest.mark.parametrize("name,mode", [(tf.TOKENIZER, "drop"), (pk.TOKENIZER, "space")])
def test_words_given_to_the_model(name, mode):
    path = public_tokenizers.path(name)
    tok, enc = Tokenizer.from_file(path), encoder(path, mode)
    assert enc.get.__self__.direct

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from(list("abthéñßÅµªºΣσςİıK")), max_size=9), max_size=6))
    def same(words):
        t = " ".join(words)
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids

    same()


def test_a_bucket_holds_one_length(spark, docs, tmp_path):
    packed = pk.pack(docs, pk.tokenizer_path(pk.TOKENIZER)).cache()
    pk.write_buckets(packed, f"{tmp_path}/b")
    lengths = {r.length for r in packed.select("length").collect()}
    assert len(lengths) > 2 and {p.name for p in (tmp_path / "b").glob("length=*")} == {f"length={n}" for n in lengths}
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/b").select("doc_id", "start", "ids_crc32").collect())) == sorted(map(str, packed.select("doc_id", "start", "ids_crc32").collect()))
    for n in lengths:
        assert spark.read.parquet(f"{tmp_path}/b/length={n}").count() == packed.where(packed["length"] == n).count()
