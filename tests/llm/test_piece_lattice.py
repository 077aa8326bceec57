import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from findinglake.llm.piece_lattice import SPACE, decode, default_model, encode, piece_table


def _best(text):
    """The best path by dynamic programming over the whole text; ties: the last piece starts earlier."""
    normal, _, first = piece_table(default_model())
    table = {p: (s, i) for p, s, i in normal}
    unknown = min(s for _, s, _ in normal) - 10
    t = (SPACE + text).replace(" ", SPACE) if text else ""
    best = [(0.0, 0, [])]
    for e in range(1, len(t) + 1):
        top = None
        for s in range(max(0, e - 16), e):
            score, i = table.get(t[s:e], (unknown, -1) if e == s + 1 else (None, None))
            if score is not None and (top is None or best[s][0] + score > top[0]):
                own = [i] if i >= 0 else [first + b for b in t[s:e].encode()]
                top = (best[s][0] + score, s, own)
        best.append(top)
    out, at = [], len(t)
    while at:
        out = best[at][2] + out
        at = best[at][1]
    return out


def _library():
    """The library's lattice over the same pieces and scores."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(default_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


TEXTS = ["Hello world", "  two  spaces ", "line\nbreak\n\n and\ttab", "naïve café — déjà vu", "日本語 text 😀", "a", " ", "",
         None, "x" * 700, "the cat sat on the mat 1234567 times!!", "▁odd"]
SCHEMA = "doc_id long, text string"


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "no id")], SCHEMA)
    got = {r.doc_id: r for r in encode(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert list(got[i].ids) == _best(t or ""), t
        assert got[i].n_pieces == len(got[i].ids)
        assert got[i].round_trip == ("▁" not in (t or ""))
    back = {r.doc_id: r.text for r in decode(encode(docs)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(TEXTS)) and back[None] == "no id"
    assert encode(docs.limit(0)).count() == 0


def test_corpus_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = encode(docs).collect()
    assert len(rows) == docs.count() and all(r.round_trip for r in rows)
    library, texts = _library(), {r.doc_id: r.text for r in docs.collect()}
    same = 0
    for r in rows:
        t = texts[r.doc_id]
        if len(t) < 2000:
            assert list(r.ids) == _best(t)
        if len(t) < 200:
            best = library.NBestEncode(t, nbest_size=1, out_type=int)[0]
            scores = list(map(library.get_score, best))
            if min(scores) > -1e6:  # the library adds in single precision; a lone space costs 1e9
                assert sum(map(library.get_score, list(r.ids))) >= sum(scores)
                same += 1
    assert same > 3


def test_long_units_and_odd_columns(spark):
    """A run of 20,000 characters that no place cuts, ids that no float holds, and columns called like results."""
    rows = [(2**53 + 1, "x" * 20_000, 1), (None, "y" * 300 + " " + "ab" * 200, 2), (2**63 - 1, "", 3), (7, "z\n\nz", 4), (7, "z\n\nz", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumn("unit", F.lit("u")).withColumn("chunk", F.lit(1))
    got = encode(docs).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == sorted((d or 0, len(_best(t))) for d, t, _ in rows)
    for r in got:
        t = next(t for d, t, _ in rows if d == r.doc_id)
        assert list(r.ids) == _best(t) and r.round_trip
