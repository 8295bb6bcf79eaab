"""Language tags against plain searches and held-out texts."""

import itertools
import random

import pyarrow as pa

from lectern.operators.languages import resolved_mode, transcript_windows
from lectern.operators.tagging import PIECE_BYTES, SWITCH, START, Model, best_path, tagged, tagged_batches, tags_of
from lectern.plans import QUERIES

SF = "/root/testdata/sf0.01"


def cost(scores, path):
    """Evidence against each word's language, and switches; home at the start is worth START."""
    total = START if not path[0] else 0.0
    total += sum(s / 2 if away else -s / 2 for s, away in zip(scores, path))
    return total - SWITCH * sum(a != b for a, b in zip(path, path[1:]))


def test_best_path_against_all_paths():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-3, 3, rng.uniform(-2.5, 2.5)]) for _ in range(rng.randint(1, 10))]
        best = max(cost(scores, p) for p in itertools.product([False, True], repeat=len(scores)))
        assert abs(cost(scores, best_path(scores)) - best) < 1e-9
    assert best_path([]) == [] and best_path([0.0, 0.0]) == [False, False]


def test_context_decides_and_doubt_abstains():
    model = Model({"the": -3.0, "and": -3.0, "der": 3.0, "und": 3.0, "die": 0.5, "in": -0.5}, frozenset({"der", "und"}), {"^q": 4.0, "q": 4.0})
    tags = lambda text: [t for _, _, t in tags_of(text, model, "en", "de", {})]
    assert tags("the die and in") == ["en"] * 4 and tags("der die und in") == ["de"] * 4
    assert tags("the and 12 der und") == ["en", "en", "ne", "de", "de"]
    # A stray word that neither language has is of neither; so is every word of a text in a third one.
    assert tags("the and qqq qqq the") == ["en", "en", "xx", "xx", "en"]
    assert set(tags("q qq qqq qqqq foo bar baz fool")) == {"xx"}
    assert tags("the слово and") == ["en", "de", "en"] and tags("") == [] and tags(None) == []


def test_held_out_texts(spark):
    """Words of English and German texts that the model has not seen are nearly all tagged as theirs."""
    rows = [r for r in QUERIES["tagged_words"](spark, SF).collect() if r.doc_id % 4 == 0]
    for lang, other in (("en", "de"), ("de", "en")):
        own, wrong = (sum(r[f"n_{x}"] for r in rows if r.lang == lang) for x in (lang, other))
        assert own > 1000 and own / (own + wrong) > 0.95, (lang, own, wrong)
    foreign = [r for r in rows if r.lang in ("fr", "es")]
    assert sum(r.n_xx for r in foreign) > 0.5 * sum(r.n_en + r.n_de + r.n_xx for r in foreign)


def test_windows(spark):
    def plain(pieces, least=12, most=40):
        out, now = [], []
        for p in pieces:
            for w in p.split():
                now.append(w)
                if len(now) == most:
                    out, now = [*out, now], []
            if len(now) >= least:
                out, now = [*out, now], []
        if now and out and len(now) < least // 2:
            out[-1] = out[-1] + now
        elif now:
            out.append(now)
        return [" ".join(w) for w in out]

    rng = random.Random(2)
    rows = [(i, [" ".join(f"w{k}" for k in range(rng.choice([0, 1, 5, 11, 12, 39, 40, 41, rng.randint(0, 130)]))) for _ in range(rng.randint(0, 6))]) for i in range(150)]
    got = {}
    for r in transcript_windows(spark.createDataFrame(rows, "id long, pieces array<string>"), "id", "pieces").orderBy("id", "window").collect():
        got.setdefault(r.id, []).append(r.text)
    assert got == {i: plain(p) for i, p in rows if plain(p)}


def test_resolved_modes(spark):
    df = spark.createDataFrame([("plain_english", "native_script"), ("roman", "native_script"), ("native_script", "roman"), ("roman", "plain_english")], "s string, q string")
    assert [r[0] for r in df.select(resolved_mode("s", "q")).collect()] == ["plain_english", "native_script", "roman", "roman"]


def test_tags_of_many_texts_are_not_held_at_once(spark):
    model = Model({"the": -3.0, "der": 3.0}, frozenset({"der"}), {})
    texts = ["the quick der x 12 " * 4000, None, "", "the " * 2, *["der fuchs " * 2000] * 200, "the der " * PIECE_BYTES]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "t"])
    out = list(tagged_batches(iter([batch]), 1, model, "en", "de", "tags", 1000))
    assert sum(b.num_rows for b in out) == len(texts) and [i for b in out for i in b.column(0).to_pylist()] == list(range(len(texts)))
    assert all(b.num_rows == 1 or sum(len(x or "") for x in b.column(1).to_pylist()) <= PIECE_BYTES for b in out)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:5])], "id int, t string")
    for r in tagged(df, model, "t", "en", "de").collect():
        assert [tuple(x) for x in r.tags] == tags_of(r.t, model, "en", "de", {})
