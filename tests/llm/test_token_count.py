import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from kinloom.llm.token_count import CountingViterbi, count_tokens, unigram_vocabulary
from tests.llm.common import ODD, docs, words

PATH = public_tokenizers.path("piece_bpe_32k.model")


def unigram(vocabulary, fallback=True):
    out = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
    out.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return out


def test_counts_are_the_tokenizers(spark):
    texts = [*ODD, " ".join(words(500, 1, "etaoinshrdlu")), "▁▁ a ▁b", "<0x41>", "x\n\ny \n z"]
    exact = unigram(unigram_vocabulary(PATH))
    rows = {r.doc_id: r.n_tokens for r in count_tokens(docs(spark, texts, extra=True), PATH).collect()}
    assert rows == {i: None if t is None else len(exact.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert count_tokens(docs(spark, []), PATH).count() == 0


def test_ties_and_scores_that_are_no_whole_numbers():
    # "ab" + "c" and "a" + "bc" score alike; the one whose last piece starts first stays
    vocabulary = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), ("▁", -1.25), ("a", -1.5), ("b", -1.5), ("c", -1.5), ("ab", -2.0), ("bc", -2.0), ("abc", -3.5), ("▁a", -2.75), ("\n", -9.0)]
    counter, exact = CountingViterbi(vocabulary), unigram(vocabulary)
    assert not counter.parts
    for text in ("abc", "abcabc", "a bc cab", "zab\nc", "éa", "abc abc abcabcab"):
        assert counter.text(text) == len(exact.encode(text, add_special_tokens=False).ids), text
