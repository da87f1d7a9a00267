"""Profiles and voice comparison."""

import pytest

from textloom.operators import corpus, profile, voice

SCHEMA = "author string, sample int, label string, type string, text string, override boolean"
PARTS = [
    "The shop opened at nine. I swept the floor, set out the bread, and waited for the first bus. Nobody came till ten. Then six people came at once!",
    "My uncle kept bees for thirty years. He never wore the gloves. When they stung him, he'd laugh and say it kept him young. I don't think it did.",
    "We drove north on the old road. It rained (as it does). The radio died near the lake, so we sang what songs we knew, badly.",
    "I mend clocks now. Most come in because someone wound them too hard; a few are past help. The good ones only want cleaning, a drop of oil, and time.",
]
STIFF = " ".join(["Furthermore, the comprehensive methodology of the aforementioned organizational restructuring necessitates considerable deliberation regarding the transformative implications of institutional accountability throughout administrative departments."] * 5)


@pytest.fixture(scope="module")
def profiles(spark):
    rows = [("me", i, f"piece {i}", "written", "\n\n".join([t] * 30), False) for i, t in enumerate(PARTS)] + [("thin", 0, "p", "written", "\n\n".join([PARTS[0]] * 5), False)]
    screened = corpus.screen(corpus.valid(spark.createDataFrame(rows, SCHEMA)))
    return profile.build(corpus.usable(screened)).persist()


def test_profile(profiles):
    rows = {r.author: r for r in profiles.collect()}
    me, thin = rows["me"], rows["thin"]
    assert me.samples == 4 and all(b.available for b in me.bands.values()) and me.absent_available and "furthermore" in me.absent
    assert len(me.openers) <= 12 and me.signature is not None
    assert not any(b.available for b in thin.bands.values())
    assert all(x is None for b in thin.bands.values() for x in (b.low, b.high, b.mean, b.sd))  # nothing leaks
    told = profile.from_json(profile.to_json(me))
    assert told["metrics"]["author"] == "me"
    for bad in ("{", "[]", '{"format": "x"}'):
        with pytest.raises(profile.ProfileError):
            profile.from_json(bad)


def test_compare(spark, profiles):
    drafts = [(1, "me", STIFF), (2, "me", "\n\n".join(PARTS)), (3, "me", "too short"), (4, "nobody", STIFF), (5, "thin", STIFF), (6, "me", None)]
    got = {r.doc_id: r for r in voice.compare(spark.createDataFrame(drafts, "doc_id long, author string, text string"), profiles).collect()}
    assert got[1].score < 60 and {"readingLevel", "sentenceLength", "absentWords"} <= {f.metric for f in got[1].findings}
    assert got[1].score == max(0, 100 - sum(f.penalty for f in got[1].findings))
    assert [f.penalty for f in got[1].findings] == sorted((f.penalty for f in got[1].findings), reverse=True)
    assert got[2].score >= 80 and got[2].band == "close"
    for i in (3, 4, 5, 6):
        assert not got[i].available and got[i].score is None and got[i].band is None and got[i].findings == [] and got[i].reason
