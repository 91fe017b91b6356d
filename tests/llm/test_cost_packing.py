import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postloom.llm import cost_packing
from postloom.llm.byte_tokens import ByteTokenizer
from postloom.llm.cost_packing import cost, pack_by_cost, plan, rooms

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, OWN = Tokenizer.from_file(VOCAB), ByteTokenizer(VOCAB)


def followed(counts, capacity):
    """Pieces of every document by the plan: {(length, nth): [(sequence, offset, tokens)]}."""
    steps = sorted(plan(counts, capacity))
    known = Counter(counts)
    for s in steps:
        known[s[0] - s[5]] += s[2] * (s[0] > s[5])
    for length, n in known.items():
        own = [s for s in steps if s[0] == length]
        assert sum(s[2] for s in own) == n and [s[1] for s in own] == np.cumsum([0, *(s[2] for s in own)])[:-1].tolist()
    out = {}
    for doc in ((length, i) for length, n in counts.items() for i in range(n)):
        (length, rank), out[doc] = doc, []
        while length:
            s = next(s for s in steps if s[0] == length and s[1] <= rank < s[1] + s[2])
            out[doc].append((s[3] + rank - s[1], s[4], s[5]))
            length, rank = length - s[5], s[6] + rank - s[1]
    return out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 25), max_size=12))
def test_plan_fills_every_room_without_gaps(counts):
    placed = followed(counts, 32)
    total = sum(k * n for k, n in counts.items())
    held = defaultdict(list)
    for doc, pieces in placed.items():
        assert sum(t for _, _, t in pieces) == doc[0]
        for seq, at, tokens in pieces:
            held[seq].append((at, tokens))
    want = [size for size, n in rooms(total, 32) for _ in range(n)]
    assert sum(want) == total and sorted(held) == list(range(len(want)))
    for seq, own in held.items():
        at = 0
        for start, tokens in sorted(own):
            assert start == at
            at += tokens
        assert at == want[seq] and (at == 32 or at & (at - 1) == 0)


def test_plan_is_the_sequential_rule_where_all_fit():
    """One document at a time to the cheapest sequence with room."""
    counts = {20: 3, 14: 2, 12: 4, 10: 1, 8: 2, 6: 4, 2: 3}
    sequences = sum(n for _, n in rooms(sum(k * n for k, n in counts.items()), 32))
    load, fill = [0] * sequences, [0] * sequences
    size = [s for s, n in rooms(sum(k * n for k, n in counts.items()), 32) for _ in range(n)]
    want = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            able = [i for i in range(sequences) if size[i] - fill[i] >= length]
            if not able:
                break
            i = min(able, key=lambda i: load[i])
            want.append((length, load[i]))
            load[i] += cost(length)
            fill[i] += length
    got = []
    spent = Counter()
    for length, _, times, seq, _, taken, _ in plan(counts, 32):
        if taken < length:
            break
        for q in range(seq, seq + times):
            got.append((length, spent[q]))
            spent[q] += cost(taken)
    assert got == want[: len(got)] and len(got) >= 8


def test_costs_are_balanced_and_the_plan_stays_small():
    rnd = np.random.default_rng(1)
    lengths = np.minimum(1024, rnd.lognormal(5.5, 1.0, 20_000).astype(int) + 1)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    steps = plan(counts)
    more = plan({k: n * 5000 for k, n in counts.items()})
    assert len(more) < 2 * len(steps) < 20_000  # as large for a hundred million documents
    spent, full = Counter(), Counter()
    for _, _, times, seq, _, taken, _ in steps:
        for q in range(seq, seq + times):
            spent[q] += cost(taken)
            full[q] += taken
    costs = np.array([spent[q] for q in spent if full[q] == 1024])
    arrival = rnd.permutation(lengths)
    ends = np.cumsum(arrival)
    plain = np.array([cost(0) + sum(cost(int(x)) for x in arrival[(ends > k) & (ends <= k + 1024)]) for k in range(0, 1024 * 1000, 1024)])
    assert costs.std() < 0.8 * plain.std()


TEXTS = [
    "", " ", "Plain words, and more.", "it's we'll 'S I'd", "ÉTÉ déjà Straße", "été combining", "x<|endoftext|>y <|ENDOFTEXT|>", "tab\there nbsp　wide\x1funit\x0b\x85",
    "a1b22 3.14... !!! ***### $5", "日本語 テスト 한국어 emoji 😀👍🏽", "İstanbul ﬁ ½ ① ²", "\n\n lines \r\n  end \n ", "Ω мир – “quotes” … €", "​ ⁠", "\U0001e900 ೳ ᲊ",
    "w." * 3000, "w" * 30_000, " " * 30_000, "^" * 30_000, "a\x00b",
]


def test_ids_are_those_of_the_library():
    assert OWN.fast is not None
    for t in TEXTS:
        assert OWN.encode(t).tolist() == LIBRARY.encode(t, add_special_tokens=False).ids, t[:40]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=40) | st.text(st.sampled_from(" \n\t  '’stremd1½Aéя.,!́あ中한"), max_size=60))
def test_ids_of_any_text(text):
    assert OWN.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_other_files_go_to_the_library():
    other = ByteTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert other.fast is None and other.encode("Some words").tolist() == other.library.encode("Some words", add_special_tokens=False).ids


def test_pieces_hold_every_id_once(spark):
    rows = [(i, ("word number %d " % i) * (i % 9)) for i in range(80)] + [(7, "again"), (7, "again"), (None, None), (None, ""), (99, "many small words " * 2000)]
    df = spark.createDataFrame([(*r, 0, 1, "x") for r in rows], "doc_id bigint, text string, length int, within int, ids string").repartition(5)
    got = pack_by_cost(df, VOCAB, capacity=64, with_ids=True).collect()
    want = Counter((doc, tuple([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0])) for doc, text in rows)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append(r)
        raw = bytes(r.ids)
        assert len(raw) == 4 * r.length and zlib.crc32(raw) == r.ids_crc32 and r.cost == cost(r.length) and r.length <= 64
    for own in held.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
    sizes = Counter(sum(r.length for r in own) for own in held.values())
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sizes == Counter(dict(rooms(total, 64))) and sorted(held) == list(range(len(held)))
    by_doc = defaultdict(Counter)
    for r in got:
        by_doc[r.doc_id][(r.start, r.length, bytes(r.ids), r.doc_tokens)] += 1
    for doc, pieces in by_doc.items():
        texts = [ids for (d, ids), n in want.items() if d == doc for _ in range(n)]
        assert sum(length * n for (_, length, _, _), n in pieces.items()) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for (start, length, raw, tokens), n in sorted(pieces.items()):
                assert n == 1 and start == at and tokens == len(texts[0])
                assert np.frombuffer(raw, "<u4").tolist() == list(texts[0][at : at + length])
                at += length
            assert at == len(texts[0])
    assert pack_by_cost(df.limit(0), VOCAB).count() == 0


def test_parts_are_placed_some_at_a_time(spark, monkeypatch):
    rows = [(i, "ab " * (7 * i % 50)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    whole = pack_by_cost(docs, VOCAB, 32, with_ids=True).collect()
    monkeypatch.setattr(cost_packing, "_PLACED", 3)
    assert sorted(map(tuple, pack_by_cost(docs, VOCAB, 32, with_ids=True).collect())) == sorted(map(tuple, whole))
