"""Source files that do not parse in the language of their path.

Tables are built once on the driver from the grammars in :mod:`tesserae.llm.syntax` and broadcast; their
size depends on the grammars alone. A worker turns each text into tokens and runs them through the
table-driven parser to the end; the first token that nothing could follow is the file's error. Texts are
parsed one by one, so no file waits for another and none is cut.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.syntax import data_formats, python, rust, script
from tesserae.llm.syntax.tables import Grammar, Parser, Tables
from tesserae.llm.tokens import slices

LANGUAGES = ("python", "javascript", "typescript", "rust", "json", "toml")


@lru_cache(None)
def tables(language: str) -> Tables:
    text, start = {
        "python": (python.GRAMMAR, "file"),
        "javascript": (script.grammar(False), "program"),
        "typescript": (script.grammar(True), "program"),
        "rust": (rust.grammar(), "file"),
        "json": (data_formats.JSON_GRAMMAR, "value"),
        "toml": (data_formats.TOML_GRAMMAR, "doc"),
    }[language]
    return Tables(Grammar(text, start))


class Checker:
    """Finds the first error of a text in one language."""

    def __init__(self, language: str, built: Tables):
        self.language = language
        number = built.terminal
        self._parser = Parser(built, number.get("';'"))
        if language in ("json", "toml"):
            lex = data_formats.json_tokens if language == "json" else data_formats.toml_tokens
            self._tokens = lambda text: lex(text, number)
        elif language == "python":
            self._tokens = python.Lexer(number).tokens
        elif language == "rust":
            self._tokens = rust.Lexer(number).tokens
        else:
            self._tokens = script.Lexer(number, language == "typescript").tokens

    def error(self, text: str) -> int | None:
        """Offset of the first error, or None. An error in Python is confirmed by the interpreter's own parser."""
        found = self._tokens(text)
        if isinstance(found, int):
            at: int | None = found
        else:
            tokens, offsets, breaks = found
            i = self._parser.error(tokens, breaks)
            at = None if i is None else offsets[min(i, len(offsets) - 1)]
        if at is not None and self.language == "python":
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    ast.parse(text)
                return None
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return at
        return at


def parse_errors(records: DataFrame, id_column: str, path_column: str, text_column: str, languages: dict[str, str]) -> DataFrame:
    """``<id>, language_name, error_line`` of each judged row; error_line is null where the text is valid.

    ``languages`` maps the last part of a path after its last dot to one of ``LANGUAGES``; rows of other
    paths, of null paths and of null or empty texts are not judged and have no row. Repeated rows are
    judged alike and stay repeated.
    """
    unknown = set(languages.values()) - set(LANGUAGES)
    if unknown:
        raise ValueError(f"no grammar for {sorted(unknown)}")
    spark = records.sparkSession
    kind = records.schema[id_column].dataType.simpleString()
    named = F.create_map(*[F.lit(x) for pair in sorted(languages.items()) for x in pair]) if languages else F.create_map()
    ext = F.regexp_extract(F.col(path_column), r"\.([^.]*)$", 1)
    language = F.element_at(named.cast("map<string,string>"), ext)
    files = records.select(F.col(id_column).alias("_id"), language.alias("_language"), F.col(text_column).alias("_text")).where("_language is not null and _text is not null and _text <> ''")
    shared = spark.sparkContext.broadcast({name: tables(name) for name in sorted(set(languages.values()))})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checkers: dict[str, Checker] = {}
        for batch in batches:
            for part in slices(batch, 2):
                names, lines = part.column(1), []
                for name, text in zip(names.to_pylist(), part.column(2).to_pylist()):
                    if name not in checkers:
                        checkers[name] = Checker(name, shared.value[name])
                    at = checkers[name].error(text)
                    lines.append(None if at is None else text.count("\n", 0, at) + 1)
                yield pa.RecordBatch.from_arrays([part.column(0), names, pa.array(lines, pa.int64())], names=["_id", "language_name", "error_line"])

    judged = files.mapInArrow(run, f"_id {kind}, language_name string, error_line long")
    return judged.select(F.col("_id").alias(id_column), "language_name", "error_line")
