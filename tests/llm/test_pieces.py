import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from docketlake.llm.pieces import Decoder, Encoder, decode_notices, encode_notices, load_vocabulary
from docketlake.llm.queries import PIECE_MODEL


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


@pytest.fixture(scope="module")
def scored(tmp_path_factory):
    """The same vocabulary as a model that scores paths; scores are dyadic, so sums are exact."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(PIECE_MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    r = random.Random(11)
    for p in model.pieces:
        if p.type == 1:
            p.score = -len(p.piece) ** 0 - r.randrange(1, 1 << 14) / (1 << 12)
    path = tmp_path_factory.mktemp("model") / "scored.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def random_texts(seed, n, size):
    r = random.Random(seed)
    letters = list("aabbeettrs   \n▁éß中😀.,01x\t&$")
    return ["".join(r.choice(letters) for _ in range(r.randint(0, size))) for _ in range(n)]


def test_ids_and_text_equal_the_library(library):
    encoder = Encoder(load_vocabulary(PIECE_MODEL))
    decoder = Decoder(encoder.v)
    for text in [*random_texts(1, 400, 60), *random_texts(2, 4, 5000), "x" * 4000, "ab" * 3000, " " * 70, "", "Layoff notice"]:
        ids = encoder.encode(text)
        assert ids == library.encode(text)
        assert decoder.decode(ids) == library.decode(ids)


def test_paths_by_score_equal_the_library(scored):
    library = sentencepiece.SentencePieceProcessor(model_file=scored)
    encoder = Encoder(load_vocabulary(scored))
    for text in [*random_texts(3, 300, 60), "layoffs" * 900]:
        assert encoder.encode(text) == library.encode(text)


def test_pieces_are_given_out_before_the_text_ends():
    encoder = Encoder(load_vocabulary(PIECE_MODEL))
    text = "closingoftheplant" * 2000
    given, first = 0, None
    window = []
    inner = encoder._extend

    def watch(text, a, b, done, best, step):
        window.append(len(best))
        return inner(text, a, b, done, best, step)

    encoder._extend = watch
    for piece in encoder.stream(text):
        given += len(piece)
        first = first or len(window)
    assert given == len(text)
    assert first < 10
    assert max(window) < 8 * encoder.v.longest


def test_frames_keep_rows_and_columns(notices, empty):
    rows = [(1, "Layoff  of 45 workers\n"), (1, "Layoff  of 45 workers\n"), (None, None), (2, ""), (3, "closing " * 5000)]
    out = decode_notices(encode_notices(notices(rows), PIECE_MODEL, ids="score"), PIECE_MODEL, ids="score", text="kept").collect()
    assert sorted((str(r.hash), r.kept) for r in out) == sorted((str(k), t or "") for k, t in rows)
    assert all(r["key"] == "z" and r.source_name == "county list" for r in out)
    assert encode_notices(empty, PIECE_MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    model = sentencepiece_model_pb2.ModelProto()
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        load_vocabulary(str(tmp_path / "m"))
