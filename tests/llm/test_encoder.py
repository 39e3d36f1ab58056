import random

import pyarrow as pa

from siltstone.llm import token_output, tokens

BYTE = tokens.vocabulary("byte_bpe_50k.json")


class Counted:
    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, piece):
        self.asked.append(piece)
        return self.model.tokenize(piece)


def test_a_word_is_tokenized_once_whatever_signs_follow():
    own = tokens.Encoder(BYTE)
    own.model = Counted(own.model)
    texts = ["so alpha$$$ alpha%%% alpha, alpha\nGrün. Grün, Grün***\nGrün", "to alpha&&& alpha. alpha!"]
    ids, sizes = own.encode(texts)
    assert ids.tolist() == [x for t in texts for x in own.whole.encode(t, add_special_tokens=False).ids]
    assert own.model.asked.count("Ġalpha") == 1
    assert len(own.model.asked) == len(set(own.model.asked))


def test_mixed_batches_give_the_library_ids():
    draw = random.Random(4)
    bits = ["a", "Wort", "é", "日", "ß", "'s", "don't", ".", ",", "$$$", "—", "»", "²", "12", " ", "\n", "\t", "\x01", "\xa0", "<|endoftext|>", "ª", "К", "İ", "'", "_", "\x00", "\x1c"]
    own = tokens.Encoder(BYTE, cached_units=500)
    for n in [0, 1, 2, 30] * 60:
        texts = ["".join(draw.choice(bits[: draw.choice([14, 16, 27])]) + draw.choice(["", " ", " ", "\n"]) for _ in range(draw.randint(0, 12))) for _ in range(n)]
        if n == 2:
            texts = [" ".join(x.split()) or "z" for x in texts]
        ids, sizes = own.encode(texts)
        whole = [own.whole.encode(x, add_special_tokens=False).ids for x in texts]
        assert sizes.tolist() == [len(x) for x in whole]
        assert ids.tolist() == [i for x in whole for i in x]


def test_slices_hold_every_row_and_few_bytes():
    texts = ["x" * 3_000_000, None, "", "y" * 9_000_000, "z" * 2_000_000, *["w"] * 1200]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]).slice(1)
    parts = list(token_output.slices(batch, 0))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts[1:]
    assert all(p.num_rows <= token_output.BATCH_ROWS and (p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= token_output.BATCH_BYTES) for p in parts)
