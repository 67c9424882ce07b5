"""Pieces and scores of a SentencePiece model file, and what encoders need of them."""

from __future__ import annotations

SPACE = "▁"


class Pieces:
    """The vocabulary of the model file at ``path``: normal pieces with scores, and the ids of byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.unk = model.unk_id()
        self.normal: dict[str, tuple[int, float]] = {}
        self.byte_ids: list[int | None] = [None] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                self.normal[piece] = (i, model.get_score(i))
        if None in self.byte_ids:
            raise ValueError(f"{path} has no piece for some bytes, so texts can't be restored")


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]
