"""What Python workers keep from task to task."""

import weakref

import pyarrow as pa

from trackloom.llm import bpe_automaton, jaccard_join, token_output, word_pieces


class Task:
    """A table that hands out the function that it would be mapped with."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_tables_of_the_tokenizer_go_when_a_task_of_another_operator_begins():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d e f", None])], names=["row", "text"])
    for f in (jaccard_join.prefix_postings, jaccard_join.shingle_sets):
        codec = bpe_automaton.codec(bpe_automaton.default_path())
        ids, gone = codec.encode("some words"), weakref.ref(codec)
        token_output.encoder(token_output.default_path())
        del codec
        assert len(list(f(Task())([batch]))) > 0
        assert gone() is None
        assert not any(c.cache_info().currsize for c in (bpe_automaton.codec, bpe_automaton.automaton, token_output.encoder, word_pieces.library, word_pieces.spec))
        assert bpe_automaton.codec(bpe_automaton.default_path()).encode("some words") == ids  # made anew
