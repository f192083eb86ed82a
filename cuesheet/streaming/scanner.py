"""Incremental reading of a compact transcript; the state of one media between batches."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

# The same pieces as the batch parser; an unfinished bracket at the end waits for more text.
_PIECE = re.compile(r"\[[0-9.]{1,32}\]|\[S[0-9]{1,15}\]|\[|[^\[]+")
_UNFINISHED = re.compile(r"\[(?:[0-9.]{0,32}|S[0-9]{0,15})\Z")
_STAMP = re.compile(r"\[([0-9]+\.?[0-9]*|\.[0-9]+)\]")
_DIGITS = re.compile(r"[0-9.]+")
SEEK, SPEAKER_NEXT, TEXT, ENDED = range(4)


@dataclass
class Scanner:
    """Feed chunks cut anywhere; complete segments come back as (start, end, speaker, text)."""

    mode: int = SEEK
    open: int = -1  # digits read after a lone '[' inside the text
    start: float = 0.0
    end: float = 0.0
    speaker: str = ""
    text: str = ""
    tail: str = ""  # a provisional end stamp and the blanks after it
    held: str = ""  # an unfinished bracket

    def feed(self, chunk: str) -> list[tuple[float, float, str, str]]:
        data = self.held + chunk
        cut = _UNFINISHED.search(data)
        self.held = data[cut.start() :] if cut else ""
        return self._read(data[: cut.start()] if cut else data)

    def close(self) -> list[tuple[float, float, str, str]]:
        found = self._read(self.held)
        if self.mode == ENDED:
            found += self._emit()
        self.__init__()
        return found

    def _read(self, data: str) -> list[tuple[float, float, str, str]]:
        found = []
        for piece in _PIECE.findall(data):
            found += self._step(piece)
        return found

    def _emit(self):
        text = self.text.strip()
        return [(self.start, self.end, self.speaker, text)] if text else []

    def _step(self, piece: str):
        stamp = _STAMP.fullmatch(piece)
        bracket = piece[0] == "["
        if self.mode == TEXT:
            self._in_text(piece, stamp, bracket)
            return []
        if not bracket:
            if piece.isspace():
                if self.mode == ENDED:
                    self.tail += piece
            elif self.mode == ENDED:  # the stamp was text after all
                self.text, self.tail, self.mode, self.open = self.text + self.tail + piece, "", TEXT, -1
            else:
                self.mode = SEEK
            return []
        done = self._emit() if self.mode == ENDED else []
        if self.mode == SPEAKER_NEXT:
            named = piece.startswith("[S")
            self.mode = TEXT if named else SEEK
            if named:
                self.speaker, self.text, self.open = piece[1:-1], "", -1
        elif stamp:
            self.mode, self.start = SPEAKER_NEXT, float(stamp.group(1))
        else:
            self.mode = SEEK
        return done

    def _in_text(self, piece: str, stamp, bracket: bool) -> None:
        if self.open < 0 and stamp and float(stamp.group(1)) >= self.start:
            self.mode, self.end, self.tail = ENDED, float(stamp.group(1)), piece
            return
        digits = not bracket and _DIGITS.fullmatch(piece)
        if self.open >= 0 and digits and self.open + len(piece) <= 32:
            self.open += len(piece)
        else:
            self.open = 0 if piece == "[" and self.open < 0 else -1
        self.text += piece

    def to_row(self) -> tuple:
        return tuple(asdict(self).values())


SCANNER_SCHEMA = "mode int, open int, start double, end double, speaker string, text string, tail string, held string"
