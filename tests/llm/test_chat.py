import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from codequarry.llm import chat as C

PARTS = ["<", "\\", "[", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "|im_end|>", "<|im_start|>",
         "<|im_sep|>", "SYS>>", "/", "s>", "x", "INST]"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=3)), max_size=9))
def test_escape_is_reversible_and_hides_control_strings(parts):
    s = "".join(parts)
    x = C.escape(s)
    assert C.unescape(x) == s
    assert not any(c in x for c in (C.START, C.SEP, C.END, "</s>", "<s>", "[INST]", "[/INST]"))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=20), st.text(max_size=40))
def test_segments_parse_back(role, text):
    segment, a, b = C.formatted(role, text)
    assert C.parsed(segment) == (role, text) and C.unescape(segment[a:b]) == text


def expected(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said),
            hashlib.sha256(said.encode()).hexdigest(), sum(len(C.formatted(r, t)[0]) for r, t in turns))


def table():
    rows = []
    for c in range(30):
        rows += [(c, 0, "system", "be kind"), (c, 1, "user", f"q{c % 5}"), (c, 2, "assistant", f"a{c % 3}")]
        rows += [(c, 3 + k, ("user", "assistant")[k % 2], f"t{c % 4}{k}") for k in range(c % 6)]
    rows += [(40, None, None, None), (40, 1, "user", ""), (41, 5, "assistant", "</s>" * 3), (41, 5, "assistant", "</s>" * 3),
             (None, 0, "user", "no id"), (43, 0, "assistant", "z" * 5000)]
    return rows


def conversations(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_read_back_matches_the_rows(spark):
    rows = table()
    df = spark.createDataFrame([r + ("n", 1) for r in rows], SCHEMA + ", node string, size int").repartition(4)
    for limit in (C.PACK, 60):
        got = C.read_back(spark, C.pack(spark, df, limit)).collect()
        want = {c: expected(t) for c, t in conversations(rows).items()}
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars)
                for r in got} == want


def test_packs_hold_each_prefix_once_with_positions_and_attention(spark):
    rows = table()
    packed = C.pack(spark, spark.createDataFrame(rows, SCHEMA))
    segs = {}
    for r in packed.segments.collect():
        segs.setdefault((r.part, r.pack), {})[r.seg] = r
    for pack in segs.values():
        at, paths = 0, set()
        for k in sorted(pack):
            s = pack[k]
            assert s.start == at and s.size == len(s.text)          # one after the other
            at += s.size
            up, chain = s, []
            while up is not None:
                chain.append(up)
                up = pack.get(up.parent)
            chain.reverse()
            assert s.depth == len(chain) - 1 and s.position == sum(x.size for x in chain[:-1])
            seen = {p for iv in s.attend for p in range(iv.start, iv.end)}
            assert seen == {p for x in chain for p in range(x.start, x.start + x.size)}
            path = tuple(x.text for x in chain)
            assert path not in paths                               # shared tokens once
            paths.add(path)
    first = sum(1 for p in segs.values() for s in p.values() if s.text == C.formatted("system", "be kind")[0])
    assert first <= len(segs) < 30


def test_no_row_holds_a_conversation_longer_than_a_pack(spark):
    rows = [(c, k, ("user", "assistant")[k % 2], f"t{k}") for c in (1, 2) for k in range(3000)]
    rows += [(3, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(5)] + [(4, 0, "user", "t0")]
    packed = C.pack(spark, spark.createDataFrame(rows, SCHEMA), 1000)
    assert packed.paths.selectExpr("max(size(path))").first()[0] <= 1000 // 32
    segments = packed.segments.collect()
    assert len({(r.part, r.pack, r.seg) for r in segments}) == len(segments)
    ends, at = {}, {}
    for r in sorted(segments, key=lambda r: (r.part, r.pack, r.seg)):
        p = (r.part, r.pack)
        assert r.start == at.get(p, 0) and r.size == len(r.text)
        at[p] = r.start + r.size
        ends[p] = r.seg + 1
        if ends[p] > 31:
            assert (r.parent, r.depth, r.position) == (r.seg - 1, r.seg, r.start)
            assert [tuple(iv) for iv in r.attend] == [(0, at[p])]
    assert max(ends.values()) == 3000 and sum(n == 3000 for n in ends.values()) == 1   # equal conversations once
    got = {r.conv_id: tuple(r)[1:] for r in C.read_back(spark, packed)
           .select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()}
    assert got == {c: expected(t) for c, t in conversations(rows).items()}


def test_own_conversation_and_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    got = C.read_back(spark, C.pack(spark, C.with_own(spark, none))).collect()
    assert [r.conv_id for r in got] == [-7]
    assert tuple(got[0])[1:] == expected([("user", C.OWN_TEXT), ("assistant", C.OWN_TEXT)])
    assert C.read_back(spark, C.pack(spark, none)).count() == 0
