"""The mixture over a whole run, beyond one frame of 512 slots."""

from collections import Counter

from namewright.llm import mixing


def test_whole_run_stays_within_a_block():
    blocks, weights = [6000] + [700] * 19, [6000**0.5] + [700**0.5] * 19
    source, slot = mixing.whole_run(blocks, weights)
    assert Counter(source.tolist()) == Counter(dict(enumerate(blocks))) and (slot[1:] > slot[:-1]).all()
    had, share, ended = Counter(), weights[0] / sum(weights), False
    for i, t in zip(source.tolist(), slot.tolist()):
        had[i] += 1
        ended |= had[i] == blocks[i]
        assert ended or abs(had[0] - (t + 1) * share) < 1 + 1e-6
    assert had[0] == 6000


def test_many_sources_keep_the_weights(spark):
    rows = [(i, "a") for i in range(8000)] + [(8000 + i, f"s{i % 600:03}") for i in range(9600)] + [(17_600, "zero")]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"a": 300.0, "zero": 0.0} | {f"s{i:03}": 1.0 for i in range(600)}
    got = sorted(mixing.mix(docs, weights).collect(), key=lambda r: r.mix_position)
    assert [r.mix_position for r in got] == list(range(len(rows))) and {r.doc_id for r in got} == {i for i, _ in rows}
    assert got[-1].source == "zero"
    # A third of the slots, of which a frame of 512 rounded quotas gave 171 in 771.
    first = [r for r in got if r.mix_slot < 900]
    assert abs(sum(r.source == "a" for r in first) / 8 - 300) < 1


def test_blocks_are_of_one_size_whatever_the_table(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i * i % 7 % 5}") for i in range(3000)], "doc_id long, source string")
    want = {r.doc_id: (r.mix_slot, r.mix_position) for r in mixing.mix(docs).collect()}
    # The bound that larger tables had larger blocks for, and a schedule in many parts.
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 100, raising=False)
    monkeypatch.setattr(mixing, "PART_BLOCKS", 7, raising=False)
    got = mixing.mix(docs).collect()
    assert {r.doc_id: (r.mix_slot, r.mix_position) for r in got} == want
    assert max(Counter(r.mix_slot for r in got).values()) == mixing.BLOCK_DOCS
