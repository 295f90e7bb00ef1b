"""Blocks of texts that are hashed together."""

from bitextra.llm.words import blocks


def test_blocks_come_while_texts_are_read():
    """A block leaves before the texts behind it are decoded, and none is lost."""
    read = []

    def texts():
        for text in ["a" * 60, None, "é" * 30, "b" * 500, "c"]:
            read.append(text)
            yield text

    found = []
    for first, last, data in blocks(texts(), 100):
        found.append((first, last, [len(x) for x in data], len(read)))
    assert found == [(0, 2, [60, 0], 3), (2, 3, [60], 4), (3, 4, [500], 5), (4, 5, [1], 5)]
    assert list(blocks([], 100)) == []
