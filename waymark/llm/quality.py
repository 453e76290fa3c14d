"""Operator 5: line-first cleaning.

Each line of a text is judged by itself; failing lines are removed, and a document that loses
more than MAX_LOSS of its word characters is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from waymark.llm.common import over_arrow
from waymark.llm.textkernel import Words, windows

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Share of a document's word characters that it may lose with its failing lines.
MAX_LOSS = 0.5
#: A line fails by its marks at this share of symbols among its characters, ...
SYMBOL_SHARE = 0.10
#: ... as navigation at this share of bars among its words, ...
BAR_SHARE = 0.15
#: ... as shouting at this share of capitals among its cased letters, ...
CAPITAL_SHARE = 0.70
#: ... as repetition below this share of distinct words, from REPEAT_WORDS words on, ...
DISTINCT_SHARE = 0.25
REPEAT_WORDS = 10
#: ... for punctuation without any of ``.,;:?!`` in this many words.
UNBROKEN_WORDS = 60
#: Lines of up to this many words may be boilerplate.
BOILERPLATE_WORDS = 30
#: Boilerplate phrases, fixed values, by language.
PHRASES = {
    "en": "all rights reserved|terms of (?:use|service)|privacy policy|cookie|copyright|licensed under|license[,.]|sign (?:in|up)|log in|subscribe|click here|read more|share (?:this|on)|back to top|javascript",
    "fr": "tous droits réservés|conditions d'utilisation|politique de confidentialité|mentions légales|se connecter|s'abonner|cliquez ici|lire la suite|partager sur|haut de page",
    "de": "alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|impressum|anmelden|registrieren|abonnieren|hier klicken|weiterlesen|teilen auf|nach oben",
    "es": "todos los derechos reservados|términos (?:de uso|y condiciones)|política de privacidad|aviso legal|iniciar sesión|suscríbete|haz clic aquí|leer más|compartir en|volver arriba",
}
BOILERPLATE = f"(?i)({'|'.join(PHRASES.values())})"
#: Text bytes that are judged at once.
JUDGED_BYTES = 1 << 20
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:?!"]] = True


class Lines:
    """Lines of a block of texts with the figures that the rules need."""

    def __init__(self, column: pa.Array) -> None:
        words = self.words = Words(column, lower=False)
        raw, texts = words.raw, words.texts
        feeds = np.flatnonzero(raw == 10) + 1
        self.begin = np.unique(np.r_[texts[:-1], feeds[feeds < len(raw)]]) if len(raw) else np.zeros(0, np.int64)
        self.begin = self.begin[self.begin < len(raw)]
        self.end = np.r_[self.begin[1:], len(raw)] if len(raw) else np.zeros(0, np.int64)
        self.end = self.end - (raw[self.end - 1] == 10)  # without the line feed
        self.text = np.searchsorted(texts, self.begin, "right") - 1
        self.first_word = np.searchsorted(words.begin, self.begin)
        self.n_words = np.diff(np.r_[self.first_word, len(words.begin)])
        self.chars = self.count(((raw & 0xC0) != 0x80) & words.inside)

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each line are marked."""
        return np.add.reduceat(mask, self.begin, dtype=np.int64) if len(self.begin) else np.zeros(0, np.int64)

    def repeated(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        out = np.zeros(len(self.begin), bool)
        full = np.flatnonzero(self.n_words)
        keys = self.words.span_hash(self.begin[full], self.end[full])
        order = np.lexsort((full, keys, self.text[full]))
        keys, text = keys[order], self.text[full][order]
        out[full[order][1:]] = (keys[1:] == keys[:-1]) & (text[1:] == text[:-1])
        return out

    def failing(self, hashes: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Lines that a rule removes."""
        raw, words = self.words.raw, self.words
        n, chars = np.maximum(self.n_words, 1), np.maximum(self.chars, 1)
        before = np.r_[np.uint8(0), raw[:-1]]
        latin = before == 0xC3
        capital = ((raw >= 65) & (raw <= 90)) | (latin & (raw >= 0x80) & (raw <= 0x9E))
        small = ((raw >= 97) & (raw <= 122)) | (latin & (raw >= 0xA0))
        capitals, smalls = self.count(capital), self.count(small)
        symbols = self.count(_SYMBOLS[raw])
        bars = self.count(raw == 124)
        bad = repeated | (symbols >= SYMBOL_SHARE * chars) & (symbols >= 3)
        bad |= (bars >= 2) & (bars >= BAR_SHARE * n)
        bad |= (self.n_words >= 4) & (capitals >= CAPITAL_SHARE * (capitals + smalls)) & (capitals >= 10)
        bad |= (self.n_words >= UNBROKEN_WORDS) & (self.count(_BREAKS[raw]) == 0)
        line_of_word = np.repeat(np.arange(len(self.begin)), self.n_words)
        order = np.lexsort((hashes, line_of_word))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line_of_word[order][1:] != line_of_word[order][:-1])
        distinct = np.bincount(line_of_word[order][new], minlength=len(self.begin))
        bad |= (self.n_words >= REPEAT_WORDS) & (distinct < DISTINCT_SHARE * n)
        brief = np.flatnonzero((self.n_words > 0) & (self.n_words <= BOILERPLATE_WORDS))
        if len(brief):
            data = memoryview(raw.tobytes())
            texts = pa.array([str(data[a:b], "utf-8", "replace") for a, b in zip(self.begin[brief].tolist(), self.end[brief].tolist())], pa.large_string())
            bad[brief] |= pc.match_substring_regex(texts, BOILERPLATE).to_numpy(zero_copy_only=False)
        return bad


def _per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, weights=values, minlength=n).astype(np.int64)


def judge(column: pa.Array) -> tuple[dict[str, np.ndarray], Lines, np.ndarray]:
    """Figures and verdict of each text of a block; the lines; which of them fail."""
    n = len(column)
    lines = Lines(column)
    words = lines.words
    hashes = words.hashes()
    n_words = np.diff(words.first)
    repeated = lines.repeated()
    failing = lines.failing(hashes, repeated)
    runs, at = windows(hashes, words.first, WINDOW)
    text_of_run = np.searchsorted(words.first, at, "right") - 1
    order = np.lexsort((runs, text_of_run))
    same = (runs[order][1:] == runs[order][:-1]) & (text_of_run[order][1:] == text_of_run[order][:-1])
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + WINDOW, -1)
    covered = np.r_[0, np.cumsum(np.cumsum(change)[:-1] > 0)] if len(hashes) else np.zeros(1, np.int64)
    text = lines.text
    word_chars = _per_text(lines.chars, text, n)
    lost = _per_text(lines.chars * failing, text, n)
    n_repeat = np.diff(covered[words.first])
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    figures = {
        "n_words": n_words.astype(np.int64),
        "word_chars": word_chars,
        "n_symbols": _per_text(lines.count(_SYMBOLS[words.raw]), text, n),
        "n_dup_lines": _per_text(repeated, text, n),
        "n_repeat_words": n_repeat.astype(np.int64),
        "base_failed": base_failed,
        "kept": ~base_failed & (lost <= MAX_LOSS * word_chars),
        "lost_chars": lost,
        "n_failed_lines": _per_text(failing, text, n),
    }
    return figures, lines, failing


def line_quality(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, lost_chars, n_failed_lines.

    Null and empty texts have no words and fail the base rule; a text of any length is judged
    whole. Repeated rows give repeated rows; a null doc_id stays null; other columns of ``docs``
    are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        figures, _, _ = judge(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, figures.values())], ["doc_id", *figures])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long, n_failed_lines long"
    return over_arrow(docs.select("doc_id", "text"), run, schema, size=JUDGED_BYTES)


def cleaned(docs: DataFrame) -> DataFrame:
    """The kept documents with all their columns; ``text`` without the failing lines.

    Lines are joined by line feeds; one at the very end of a text is not kept. Null and empty
    texts go, repeated rows stay repeated, and other columns keep their values, also under the
    names of the figures.
    """
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        figures, lines, failing = judge(batch.column("text"))
        kept = figures["kept"]
        data = lines.words.raw.tobytes()
        out: list[list[str]] = [[] for _ in kept]
        for i in np.flatnonzero(~failing & kept[lines.text] if len(kept) else []):
            out[lines.text[i]].append(data[lines.begin[i] : lines.end[i]].decode("utf-8", "replace"))
        texts = pa.array(["\n".join(x) for x in out], pa.string())
        columns = [texts if c == "text" else batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(kept))

    return over_arrow(docs, run, docs.schema, size=JUDGED_BYTES)
