"""Perspective rotation against a plain version."""

from collections import defaultdict

from tidewise.llm import chat


def brute(rows, max_turns):
    """Whole renderings with their spans, and then the parts that they are cut to."""
    clean = lambda s: s.replace("<|", "< |")
    whole = defaultdict(list)
    for conv, turn, role, text in rows:
        whole[conv].append((turn is not None, turn or 0, clean(role or "unknown"), clean(text or "")))
    out = {}
    for conv, turns in whole.items():
        turns.sort()
        for me in {t[2] for t in turns} - {"system"}:
            at = 0
            for first in range(0, len(turns), max_turns):
                text, spans, begin, part = "", [], at, turns[first : first + max_turns]
                for _, _, who, words in part:
                    text += "<|assistant|>\n" if who == me else "<|system|>\n" if who == "system" else f"<|user name={who}|>\n"
                    if who == me:
                        spans.append(f"{at + len(text)}:{at + len(text) + len(words) + 7}")
                    text += words + "<|end|>\n"
                at += len(text)
                out[conv, first // max_turns, me] = (len(part), len(spans), begin, text, ",".join(spans))
    return out


def test_rotation(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(9001, i, "anna bo cy".split()[i % 3], f"turn é😀 {i}") for i in range(40)]
    rows += [(9002, 0, None, None), (9002, None, "x", "first"), (9003, 0, "system", "alone"), (None, 1, "user", "<|end|> forged"), (9004, 1, "a", "tie"), (9004, 1, "a", "tie"), (9005, 0, "a", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "'z' as speaker", "2 as turns", "7 as begin", "8 as p")
    for max_turns in (512, 8):
        got = {(r.conv_id, r.part, r.speaker): (r.n_turns, r.n_own, r.begin, r.rendered, r["mask"]) for r in chat.rotate(turns, max_turns).collect()}
        assert got == brute(rows, max_turns)
        for _, _, begin, text, mask in got.values():
            assert all(text[int(a) - begin : int(b) - begin].endswith("<|end|>") for a, b in (s.split(":") for s in mask.split(",")))
    assert chat.rotate(turns.limit(0)).count() == 0


def test_every_participant_gets_every_part(spark):
    """A speaker who is silent in a part still gets it, and turns without or with equal numbers are cut as well."""
    rows = [(1, i, "late" if i == 19 else "early", f"t{i}") for i in range(20)]
    rows += [(2, None, "a", f"n{i:02}") for i in range(20)] + [(3, 4, "b", "same")] * 20 + [(None, i, "c", f"x{i}") for i in range(20)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.part, r.speaker): r for r in chat.rotate(turns.repartition(5), 8).collect()}
    who = {1: ("early", "late"), 2: ("a",), 3: ("b",), None: ("c",)}
    assert set(got) == {(c, p, s) for c, names in who.items() for s in names for p in range(3)}
    assert all(r.n_turns == (8, 8, 4)[p] for (_, p, _), r in got.items())
    assert {k: (r.n_turns, r.n_own, r.begin, r.rendered, r["mask"]) for k, r in got.items()} == brute(rows, 8)
    whole = {(c, s): v for (c, _, s), v in brute(rows, 10**6).items()}
    for c, s in whole:
        parts = [got[c, p, s] for p in range(3)]
        assert "".join(r.rendered for r in parts) == whole[c, s][3] and ",".join(r["mask"] for r in parts if r["mask"]) == whole[c, s][4]
