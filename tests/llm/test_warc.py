"""Members that are cut off and written again, as round_trip's torn pages are."""

import io
import random

from repograph.llm import warc


def _salvaged(data):
    return list(warc.salvage(warc._Window(io.BytesIO(data), len(data)), 0, len(data), True))


def _member(i):
    rng = random.Random(i)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    body = "<p>" + " ".join(rng.choice(words) for _ in range(rng.randint(100, 500))) + "</p>"
    return warc.member(warc.record(i, f"http://x/{i}", body))


def test_a_torn_member_does_not_repeat_the_whole_one_behind_it():
    for i in range(400):
        whole = _member(i)
        half = whole[: len(whole) // 2]
        assert [(r[0], r[1]) for r in _salvaged(half + whole + _member(-1)) if r[5]["warc-page-id"] == str(i)] == [(len(half), len(half) + len(whole))]


def test_a_torn_member_keeps_its_own_records():
    two = warc.member(warc.record(1, "a", "x") + warc.record(2, "b", "y"))
    got = _salvaged(two[:-5] + _member(3))
    assert [r[5]["warc-page-id"] for r in got] == ["1", "2", "3"]


def test_few_inflations_of_sound_and_torn_members(monkeypatch):
    made, real = [], warc.zlib.decompressobj
    monkeypatch.setattr(warc.zlib, "decompressobj", lambda *a: made.append(1) or real(*a))
    whole = _member(1)
    _salvaged(whole)
    assert len(made) == 1
    pieces = list(warc._pieces(warc._Window(io.BytesIO(whole[:300] + whole), 300 + len(whole)), 0))
    assert len(pieces) < 20
