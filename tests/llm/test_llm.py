"""Training-data operators against libraries, brute force and held-out rows, with odd inputs."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cumula.llm import components, cotraining, line_dedup, mpeg_audio, packing, quality_rules, queries, range_coder, sentencepiece_codec, simhash, token_counts, token_files, toxicity

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a  b <|endoftext|> c<|endoftext|>d's"), (5, "long word " * 3000), (6, "\n\n a　b \x1c c"), (6, "\n\n a　b \x1c c"), (7, "▁x▁▁y <s> 日本 é 😀 <0x41>"),
    (None, "no id at all"), (8, "one two three"), (9, "ONE  two\tthree"), (10, "x" * 5000),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, None if d == 4 else "src", None if d == 5 else "en", 1, "clash") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def key(d):
    return (d is None, d or 0)


def test_sentencepiece_equals_library(docs, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))

    def want(r):
        ids = [*sp.encode(r.text or ""), sp.eos_id()]
        return (*key(r.doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())

    got = sorted((*key(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepiece_codec.encode_digests(both, PIECES).collect())
    assert got == sorted(map(want, both.collect()))


def test_sentencepiece_spans_cover_the_text(odd):
    for r in sentencepiece_codec.encode_documents(odd, PIECES).collect():
        text = next(t or "" for d, t in ODD if d == r.doc_id).encode()
        assert r.span_end[-1] == r.span_begin[-1] == len(text)
        assert r.span_begin[0] == 0 and all(b <= e for b, e in zip(r.span_begin, r.span_end, strict=True))
        assert all(e == b for e, b in zip(r.span_end, r.span_begin[1:], strict=False))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
def test_normaliser_equals_library(rule, squeeze):
    n = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    spec = {k: v for k, _, v, _, _ in sentencepiece_codec._fields(n.serialized_normalizer_spec())}
    c = object.__new__(sentencepiece_codec.Codec)
    c.map, c.user, c.suffix = sentencepiece_codec.CharacterMap(spec[2]), None, False
    c.dummy, c.squeeze, c.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    for text in ("ﬁn ①  Ａ", " 　x ", "é ½", "", "ガ Ω", "a​b"):
        norm, offsets = n.normalize(text, with_offsets=True)
        mine, align = c.normalise(text)
        assert mine == norm
        starts = np.cumsum([0, *(len(ch.encode()) for ch in mine)])
        source = np.cumsum([0, *(len(ch.encode()) for ch in text)])
        assert [int(align[s]) for s in starts] == [int(source[o]) for o in offsets]


def test_decode_of_any_ids_equals_library():
    c, sp, rnd = sentencepiece_codec.Codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES), np.random.default_rng(0)
    for _ in range(500):
        ids = [int(x) for x in np.where(rnd.random(6) < 0.5, rnd.integers(0, 259, 6), rnd.integers(259, 32000, 6))]
        assert c.decode(ids) == sp.decode(ids)


def test_token_counts_equal_library(docs, odd):
    tk = Tokenizer.from_file(BYTE_BPE)
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = sorted((*key(r.doc_id), len((r.text or "").encode()), len(tk.encode(r.text or "", add_special_tokens=False).ids)) for r in both.collect())
    assert sorted((*key(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.token_counts(both, BYTE_BPE).collect()) == want
    assert token_counts.token_counts(both.limit(0), BYTE_BPE).count() == 0


def test_token_files_round_trip(docs, odd):
    tk = Tokenizer.from_file(BYTE_BPE)
    both = docs.select("doc_id", "text").union(odd.where("doc_id > 3").select(F.col("doc_id") + 1_000_000, "text"))
    start, want = 0, []
    for r in sorted(both.collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = [*tk.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in token_files.round_trip(both, BYTE_BPE).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(want)
    assert token_files.round_trip(odd.where("doc_id is null"), BYTE_BPE).first().n_tokens > 1
    assert token_files.round_trip(both.limit(0), BYTE_BPE).count() == 0


def test_range_coder():
    rng = np.random.default_rng(1)
    for x in ([], [0], [65535] * 5, rng.integers(0, 65536, 5000), rng.zipf(1.3, 9000) % 50257, np.zeros(2048), np.zeros(4097)):
        assert (range_coder.decode(range_coder.encode(np.array(x))) == np.array(x)).all()
    data = range_coder.encode(rng.integers(0, 300, 6000))
    wrong = bytearray(data)
    wrong[60] ^= 4
    for bad in (bytes(wrong), data[:-3], b"x" + data):
        with pytest.raises(ValueError):
            range_coder.decode(bad)
    with pytest.raises(ValueError):
        range_coder.encode(np.array([65536]))


def test_mpeg_audio(spark, odd):
    for _, t in ODD:
        payload = mpeg_audio.padded(t)
        media = mpeg_audio.carry(payload)
        s = mpeg_audio.parse(media)
        assert mpeg_audio.carried(media, s) == payload and s.bad_crc == 0 and s.skipped == 0 and s.table_frames == len(s.frames)
        assert s.seconds == len(payload) / 16000 and len(s.toc) == 100 and s.tags == {"TIT2": "text"}
    media = mpeg_audio.carry(mpeg_audio.padded("hello" * 1000))
    torn = mpeg_audio.parse(media[:3000] + b"junk\xff\xf2" + media[3007:])
    assert torn.resyncs == 1 and torn.skipped > 0 and len(torn.frames) < len(mpeg_audio.parse(media).frames)
    flipped = bytearray(media)
    flipped[mpeg_audio.id3_size(media) + 648 + 8] ^= 1
    assert mpeg_audio.parse(bytes(flipped)).bad_crc == 1
    tagged = mpeg_audio.parse(media + b"TAG" + bytes(125))
    assert tagged.trailer == 128 and tagged.offsets == mpeg_audio.parse(media).offsets and tagged.skipped == 0
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (40).to_bytes(4, "little") + bytes(16)
    assert mpeg_audio.parse(media + bytes(8) + ape + b"TAG" + bytes(125)).trailer == 168
    got = spark.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray(b"\xff" * 9))], "k int, media binary")
    rows = {r.k: r.audio for r in mpeg_audio.audio_columns(got).collect()}
    assert rows[1].frames == 9 and rows[2].frames == 0 and rows[3].seconds == 0
    digests = {(r.doc_id, r.payload_sha256) for r in mpeg_audio.media_digests(odd).collect()}
    assert (2, hashlib.sha256(b"\xff" * 576).hexdigest()) in digests and len(digests) == len(ODD) - 1


def carried_whole(payload):
    media = mpeg_audio.carry(payload)
    stream = mpeg_audio.parse(media)
    return mpeg_audio.carried(media, stream) == payload and stream.skipped == stream.trailer == 0


def test_nested_marks_whose_size_leads_to_a_frame_stay_sound():
    text = ("a" * 473 + "APETAGEX" + "\0\0\0\0" + "\x08\x02\0\0").ljust(505, "x") + "TAG" + "c" * 40
    for units in range(4):
        assert carried_whole(mpeg_audio.padded("b" * 576 * units + text))
    frame, body, unit, tried = mpeg_audio.CARRIER_FRAME, mpeg_audio.CARRIER_BODY, mpeg_audio.CARRIER_UNIT, 0
    for units in range(1, 5):
        whole = len(mpeg_audio.carry(bytes(unit * units)))
        first = whole - units * frame

        def place(at, first=first, units=units):
            k, o = divmod(at - first, frame)
            return k * unit + o - body if body <= o < body + unit and 0 <= k < units else None

        for nested in (False, True):
            cut = whole - 128 * nested
            for flag in (0, 0x80):
                for k in range(-1, units):  # the footer names the start of this frame, the first being that of the table
                    size = cut - first - k * frame - (32 if flag else 0)
                    footer = b"APETAGEX" + bytes(4) + size.to_bytes(4, "little", signed=True) + bytes(4) + bytes([0, 0, 0, flag]) + bytes(8)
                    marks = {cut - 32 + i: b for i, b in enumerate(footer)} | ({cut + i: b for i, b in enumerate(b"TAG")} if nested else {})
                    if size > 0 and all(place(at) is not None for at in marks):
                        payload = bytearray(b"q" * unit * units)
                        for at, b in marks.items():
                            payload[place(at)] = b
                        assert carried_whole(bytes(payload))
                        tried += 1
    assert tried > 10


def test_random_texts_with_marks_stay_whole():
    rnd = np.random.default_rng(6)
    for _ in range(800):
        b = bytearray(rnd.bytes(int(rnd.integers(40, 2000))))
        for _ in range(6):
            mark, at = (b"TAG", b"APETAGEX", b"ID3", b"\xff\xfb", b"Xing", b"VBRI")[rnd.integers(6)], int(rnd.integers(len(b) - 20))
            b[at : at + len(mark)] = mark
        assert carried_whole(bytes(b) + b"\xff" * (-len(b) % 576))


@pytest.mark.parametrize("tag", ["TAG", "APETAGEX"])
def test_texts_that_look_like_tags_stay_whole(tag):
    """A tag's letters at any place of the last or another frame are sound; frames are counted by their fixed length."""
    for at in (*range(400, 577), 1000, 1081, 1136):
        for behind in ("", "b" * 60, "\x28\0\0\0" + "c" * 80):
            payload = mpeg_audio.padded("a" * at + tag + behind)
            media = mpeg_audio.carry(payload)
            stream = mpeg_audio.parse(media)
            assert mpeg_audio.carried(media, stream) == payload
            first = mpeg_audio.id3_size(media) + mpeg_audio.CARRIER_FRAME
            assert stream.offsets == list(range(first, len(media), mpeg_audio.CARRIER_FRAME))
            assert "frames=" in mpeg_audio.feature(stream)
    assert "frames=0" in mpeg_audio.feature(mpeg_audio.parse(b""))


def test_layer_one_checksums():
    """32 kHz stereo at 32 kbit/s: frames of 48 bytes, bit allocation of 32 bytes; layer II counts as unchecked."""
    head = bytes([0xFF, 0xFE, 0x18, 0x00])
    body = bytes(range(42))
    good = head + mpeg_audio.crc16(head[2:] + body[:32]).to_bytes(2, "big") + body
    assert mpeg_audio.header(good, 0).length == len(good) == 48
    one = mpeg_audio.parse(good * 3)
    assert (one.checked, one.bad_crc, one.unchecked) == (3, 0, 0)
    wrong = bytearray(good * 3)
    wrong[48 + 10] ^= 1
    assert mpeg_audio.parse(bytes(wrong)).bad_crc == 1
    two = bytes([0xFF, 0xFC, 0x18, 0x00]) + bytes(144 - 4)
    assert mpeg_audio.parse(two * 2).unchecked == 2


def test_simhash_equals_brute_force(docs, odd):
    both = docs.select("doc_id", "text").union(odd.select(F.col("doc_id") + 10_000, "text"))
    rows = both.collect()
    fp = np.array([simhash.fingerprint(r.text) for r in rows], np.uint64)
    near, label = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, np.array([r.doc_id if r.doc_id is not None else 1 << 60 for r in rows])
    while True:
        new = np.array([label[near[i]].min() for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    want = sorted((*key(r.doc_id), f"{int(f):016x}", None if c == 1 << 60 else int(c)) for r, f, c in zip(rows, fp, label, strict=True))
    assert sorted((*key(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(both).collect()) == want


def test_simhash_chunks_and_long_chains(spark):
    """A chain of one-bit steps, tiles cut into chunks of two rows, and a dense group."""
    chain = [((1 << k) - 1) - (1 << 63) * 0 for k in range(40)]
    dense = [0x5555000000000000 ^ (1 << k) for k in range(20)]
    nodes = spark.createDataFrame([(x,) for x in sorted({*chain, *dense})], "fp long")
    roots = {r.node: r.root for r in components.connected_components(simhash.links(nodes, 3, tile_rows=2)).collect()}
    assert {roots[x] for x in chain} == {0} and len({roots[x] for x in dense}) == 1
    assert simhash.links(nodes.limit(0)).count() == 0


def test_near_copy_stage_equals_brute_force(spark, sf, docs, odd):
    """Pairs at Jaccard 0.8 to 0.9 lie beyond op7's 3 bits; texts just below 0.8 stay."""
    rng = np.random.default_rng(5)
    planted = []
    for k in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        near, far = list(words), list(words)
        for at in (40, 90, 140):
            near[at] = "changed"
        for at in (30, 70, 110, 150, 190):
            far[at] = f"other{at}"
        planted += [(20_000 + 10 * k, " ".join(words)), (20_001 + 10 * k, " ".join(near)), (20_002 + 10 * k, " ".join(far))]
    both = docs.select("doc_id", "text").union(odd.where("doc_id is not null").select(F.col("doc_id") + 10_000, "text")).union(spark.createDataFrame(planted, "doc_id long, text string"))
    rows = both.collect()
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    label = np.array([r.doc_id for r in rows])
    near = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while True:
        new = label.copy()
        for i, j in near:
            new[i] = new[j] = min(new[i], new[j])
        if (new == label).all():
            break
        label = new
    out = corpus_pipeline.drop_near_duplicates(spark, both, sf)
    kept = {r.doc_id for r in out.collect()}
    assert kept == set(label.tolist())
    assert not any(20_001 + 10 * k in kept for k in range(30)) and all(20_002 + 10 * k in kept for k in range(30))


def test_near_copies_in_large_buckets(spark, monkeypatch):
    """Chunks of three texts a tile side give the same groups; ties, repeated ids and clashing columns."""
    from cumula.llm import near_copies

    base = [f"word{k}" for k in range(60)]
    rows = []
    for k in range(25):
        words = list(base)
        words[k * 2] = f"new{k}"
        rows.append((k, " ".join(words), "x"))
    rows += [(3, "an entirely other text that has the same id here", "y"), (30, rows[3][1], "z"), (30, rows[3][1], "a"), (None, rows[3][1], "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _keep string")
    whole = sorted(map(str, near_copies.near_copies(df).collect()))
    monkeypatch.setattr(near_copies, "TILE_TEXTS", 3)
    assert sorted(map(str, near_copies.near_copies(df).collect())) == whole
    kept = sorted(map(tuple, near_copies.keep_first(df).collect()), key=str)
    assert kept == sorted([(0, rows[0][1], "x"), (3, rows[25][1], "y"), (None, rows[3][1], "n")], key=str)
    assert near_copies.keep_first(df.limit(0)).count() == 0


def test_near_copies_compare_fingerprints_in_tiles(spark, sf, monkeypatch):
    """The candidates are what lies within the radius, of all pairs by brute force; chunks of seven fingerprints too."""
    from cumula.llm import near_copies

    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    rows = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(250).collect()]
    for k in range(60):  # copies with one word changed, of 8 to 127 words
        text = list(rng.choice(words, 8 + 2 * k))
        rows += [" ".join(text), " ".join([*text, "more"]), " ".join([*text[: len(text) // 2], "changed", *text[len(text) // 2 :]])]
    sets = {near_copies._node(h): h for h in map(near_copies.shingles, rows)}
    node, n = np.array(list(sets)), np.array([len(h) for h in sets.values()])
    fps = np.array([near_copies.wide_fingerprint(h) for h in sets.values()])
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2, dtype=np.int64)
    fit = (5 * np.minimum(n[:, None], n) >= 4 * np.maximum(n[:, None], n)) & (np.minimum(n[:, None], n) >= 4)
    alike = np.array([[5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets.values()] for a in sets.values()])
    assert alike.sum() > len(sets) + 60 and (apart[alike] <= near_copies.RADIUS).all()
    want = near_copies.local_forest(len(node), *np.nonzero((apart <= near_copies.RADIUS) & fit))
    df = spark.createDataFrame([(int(x), len(h), near_copies.wide_fingerprint(h).tobytes()) for x, h in sets.items()], "node long, n long, fp binary")
    at = {int(x): k for k, x in enumerate(node)}
    for chunk in (near_copies.TILE_ROWS, 7):
        monkeypatch.setattr(near_copies, "TILE_ROWS", chunk)
        got = [(at[r.u], at[r.v]) for r in near_copies.close_links(df).collect()]
        u, v = np.array(got, np.int64).reshape(-1, 2).T
        assert (near_copies.local_forest(len(node), u, v) == want).all()
    assert near_copies.close_links(df.limit(0)).count() == 0


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    mark = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(mark), len(w) < 10 or 100 * len(mark) > 20 * len(w)


def test_quality_rules_equal_brute_force(spark, sf, docs, odd):
    import xxhash

    both = docs.select("doc_id", "text").union(odd.select(F.col("doc_id") + 10_000, "text"))
    rows, labels = both.collect(), spark.read.parquet(f"{sf}/labels.parquet")
    trusted = {r.doc_id for r in quality_rules.trusted_ids(labels).collect()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        pair = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h[:-1], h[1:], strict=True)]
        return [signed(x) % quality_rules.BUCKETS for x in h + pair]

    raw, halves, q = np.zeros(quality_rules.BUCKETS), np.zeros((2, quality_rules.BUCKETS)), quality_rules
    for r in rows:
        np.add.at(raw, grams(r.text), 1)
        if r.doc_id in trusted:
            half = signed(xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little"), 42)) % 2
            np.add.at(halves[half], grams(r.text), 1)
    share = (raw + 1) / (raw.sum() + q.BUCKETS)
    ratios = [np.log((1 - q.FLOOR_SHARE) * t / t.sum() / share + q.FLOOR_SHARE) for t in (halves[0] + halves[1], *halves)]
    expected = (halves[0] @ ratios[2] + halves[1] @ ratios[1]) / halves.sum()
    spread = ((halves[0] @ ratios[2] ** 2 + halves[1] @ ratios[1] ** 2) / halves.sum() - expected**2) ** 0.5
    want = {}
    for r in rows:
        base, g = brute_base(r.text), grams(r.text)
        mean = float(ratios[0][g].mean()) if g else 0.0
        want[key(r.doc_id), r.text] = (*base, not base[-1] and mean >= expected - q.ERRORS * spread / max(1, len(g)) ** 0.5 - q.MARGIN, mean)
    got = quality_rules.judge(both, quality_rules.trusted_ids(labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[key(r.row.doc_id), r.row.text]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == w[:-1]
        assert r.mean_log_ratio == pytest.approx(w[-1], abs=1e-9)
    assert quality_rules.quality_rules(both.limit(0), labels.limit(0)).count() == 0


def test_line_dedup_equals_sql(spark, sf, docs):
    c = duckdb.connect()
    rows = [(1, "A line of words here.\nshort\nAnother line of words."), (2, "A line of words herz.\nshort\n\nA line of words, here."), (3, None), (4, ""), (5, "A line of words here."), (5, "A line of words here."), (5, "Another text of this id"), (6, "xA line of words here.\nzz top band of yore"), (7, "zz top band of yor\nunrelated words stand here")]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), small):
        documents = df.toPandas()  # noqa: F841
        want = sorted(map(str, c.sql(queries.LINE_DEDUP_SQL).fetchall()))
        assert sorted(str(tuple(r)) for r in line_dedup.line_dedup(df).select("doc_id", "text", "n_lines", "n_removed", "emptied").collect()) == want
    nameless = spark.createDataFrame([(None, "A line of words here.\nA line of words here.", 7)], "doc_id long, text string, h long")
    assert line_dedup.without_repeated_lines(nameless).first() == nameless.first()
    assert line_dedup.line_dedup(small.limit(0)).count() == 0


def test_within_one_edit():
    for a, b, near in (("abc", "abc", True), ("abc", "abd", True), ("abc", "ab", True), ("abc", "xabc", True), ("abc", "acb", False), ("abc", "a", False), ("", "a", True), ("aab", "aba", False)):
        assert line_dedup.within_one(a, b) == near == line_dedup.within_one(b, a)


def test_packing_rules(docs, odd):
    both = docs.select("doc_id", "text", "source").union(odd.select(F.col("doc_id") + 10_000, "text", "source"))
    source = {(r.doc_id, r.text): r.source for r in both.collect()}
    size = collections.Counter()
    for (d, t), _ in source.items():
        size[d] += max(1, -(-(len((t or "").encode()) + 1) // packing.CAPACITY))
    rows = packing.pack(both).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    owner = {d: s for (d, _), s in source.items()}
    for members in bins.values():
        used = sorted((r.bin_offset, r.unit_end - r.unit_begin) for r in members)
        assert used[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(used, used[1:], strict=False))
        assert sum(n for _, n in used) == members[0].bin_units <= packing.CAPACITY
        named = [owner[r.doc_id] for r in members if owner[r.doc_id]]
        assert len(named) == len(set(named))
    assert packing.pack(both.limit(0)).count() == 0


def test_packing_of_input_laid_out_by_source(spark):
    """A partition a source, one row repeated a hundred times, one long text: same bins at every layout, and full ones."""
    rows = [(1000 * s + k, "x" * (500 + 37 * k), f"source{s}") for s in range(20) for k in range(40)] + [(7, "y" * 300, "hot")] * 100 + [(8, "z" * 30_000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    laid, one = df.repartitionByRange(21, "source"), df.coalesce(1)
    cluster = F.col("doc_id")
    got = [sorted(tuple(r) for r in packing.pack(x, block_pieces=300, cluster=cluster).collect()) for x in (laid, one)]
    assert got[0] == got[1] and len(got[0]) == 20 * 40 + 100 + 4
    bins = {r[2]: r[6] for r in got[0]}
    assert len(bins) < 300  # one bin a piece would be 904; the repeated row needs 100
    assert max(sum(r[2] == b for r in got[0] if r[0] == 7) for b in bins) == 1


def test_best_fit_equals_plain_search():
    rng = np.random.default_rng(3)
    lengths, sources, clusters = [int(x) for x in rng.integers(1, 60, 300)], [int(x) for x in rng.integers(0, 5, 300)], [int(x) for x in rng.integers(0, 200, 300)]
    bins, _ = packing.best_fit(lengths, sources, clusters, 100)
    state = []
    for p in sorted(range(300), key=lambda i: (-lengths[i], i)):
        fits = [(100 - sum(lengths[q] for q in b), k) for k, b in enumerate(state) if sum(lengths[q] for q in b) + lengths[p] <= 100 and all(sources[q] != sources[p] and clusters[q] != clusters[p] for q in b)]
        k = min(fits)[1] if fits else len(state)
        if not fits:
            state.append([])
        state[k].append(p)
        assert bins[p] == k


def test_toxicity_on_held_out_rows(spark, odd):
    sf = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = lab.where(toxicity.fold(F.col("doc_id")) == 0)
    model = toxicity.fit(d, lab)
    got = toxicity.with_scores(d.join(F.broadcast(held), "doc_id").select("doc_id", "text", "toxic"), model).toPandas()
    rank, y = got.score.rank(), got.toxic == 1
    assert (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()) > 0.93
    assert ((got.score >= 0.5) == y).mean() > 0.94
    scored = toxicity.with_scores(odd.drop("score"), model)
    assert scored.count() == len(ODD) and scored.where("score between 0 and 1").count() == len(ODD)
    with pytest.raises(ValueError):
        toxicity.with_scores(odd, model)
    assert toxicity.fit(d, lab.limit(0)) is None
    assert toxicity.with_scores(odd.drop("score"), None).where("score = 0").count() == len(ODD)


def test_cotraining_on_held_out_rows(spark, odd):
    sf = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = cotraining.fit(d, lab)
    held = lab.where(toxicity.fold(F.col("doc_id")) == 0).select("doc_id", "quality")
    got = cotraining.score(d, model).join(held, "doc_id").toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.95
    assert ((got.score >= 0.5) & (got.quality == 1)).sum() > 0.97 * (got.quality == 1).sum()
    assert cotraining.score(odd, model).where("score between 0 and 1").count() == len(ODD)
    blank = cotraining.fit(d.limit(0), lab.limit(0))
    assert cotraining.score(odd, blank).count() == len(ODD)


def test_toxicity_trains_in_a_task(spark, sf):
    """No text of the sample reaches the driver, and the model is that of the same rows trained here."""
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    toxicity._WORDS.clear()
    model = toxicity.fit(d, lab)
    assert len(toxicity._WORDS) == 0
    rows = sorted(toxicity.labelled_sample(d, lab, "toxic").collect(), key=lambda r: (r.doc_id, r.y))
    own = toxicity.train([(int(r.fold), r.text, r.lang, r.y) for r in rows])
    ids = [toxicity._ids(r.text) for r in rows]
    assert np.allclose(model.scores(ids), own.scores(ids), atol=1e-3)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        left = {r.doc_id for r in out.collect()}
        assert left <= ids and len(left) > 0
        docs, ids = out, left
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()} == ids
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_empty_tables(spark, odd, docs):
    """Operators without rows give an empty result with their columns."""
    none = odd.limit(0)
    assert sentencepiece_codec.encode_digests(none, PIECES).count() == 0
    assert mpeg_audio.media_digests(none).count() == 0
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = cotraining.fit(none, labels)
    assert cotraining.score(none, model).count() == 0
    assert cotraining.score(odd, model).count() == len(ODD)
    assert packing.pack(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_clashing_columns_in_stages(spark, sf, odd):
    clash = odd.withColumnRenamed("score", "_toxicity").withColumn("_keep", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, sf).columns == clash.columns, name


def test_components_end_with_stars(spark, monkeypatch):
    """Links that are stars take no round; chains, rings and hubs come back whole, and the rounds stay few."""
    tables, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df: tables.append(1) or write(df))
    star = [(k, 1) for k in range(2, 40)] + [(1, 17), (5, 5), (None, 3), (90, 80), (80, 90)]
    roots = {r.node: r.root for r in components.connected_components(spark.createDataFrame(star, "u long, v long")).collect()}
    assert roots == {k: 1 for k in range(1, 40)} | {80: 80, 90: 80}
    assert len(tables) == 1
    tables.clear()
    rng = np.random.default_rng(3)
    names = rng.permutation(300).tolist()
    edges = [(names[k], names[k + 1]) for k in range(99)] + [(names[100 + k], names[100 + (k + 1) % 100]) for k in range(100)] + [(names[200], names[k]) for k in range(201, 300)] + [(-7, names[250])]
    rows = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    least = [min(names[:100]), min(names[100:200]), -7]
    assert len(rows) == 301 and {r.node: r.root for r in rows} == {n: least[k // 100] for k, n in enumerate(names)} | {-7: -7}
    assert 2 <= len(tables) <= 8
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
