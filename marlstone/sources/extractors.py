"""Text blocks of binary documents.

Each extractor takes the bytes of one file and yields blocks.  The libraries are optional; a
file that can't be read, or whose library is missing, gives one row with an error and no
text.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Extractor = Callable[[bytes], Iterator[str]]


def pdf_blocks(content: bytes) -> Iterator[str]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for n, page in enumerate(doc, 1):
            if text := page.get_text().strip():
                yield f"[第{n}页 文字]\n{text}"


def docx_blocks(content: bytes) -> Iterator[str]:
    import docx

    doc = docx.Document(io.BytesIO(content))
    yield from (p.text for p in doc.paragraphs if p.text.strip())
    for table in doc.tables:
        yield from (" | ".join(cell.text for cell in row.cells) for row in table.rows)


def pptx_blocks(content: bytes) -> Iterator[str]:
    import pptx

    for n, slide in enumerate(pptx.Presentation(io.BytesIO(content)).slides, 1):
        texts = [s.text for s in slide.shapes if getattr(s, "text", "").strip()]
        if texts:
            yield "\n".join([f"[第{n}页]", *texts])


def image_blocks(content: bytes, languages: str = "chi_sim+eng", least: int = 10) -> Iterator[str]:
    import pytesseract
    from PIL import Image

    text = pytesseract.image_to_string(Image.open(io.BytesIO(content)).convert("RGB"), lang=languages).strip()
    if len(text) > least:
        yield text


def plain_blocks(content: bytes) -> Iterator[str]:
    yield content.decode("utf-8", "replace")


EXTRACTORS: dict[str, Extractor] = {
    "pdf": pdf_blocks, "docx": docx_blocks, "pptx": pptx_blocks, "md": plain_blocks, "txt": plain_blocks,
    "png": image_blocks, "jpg": image_blocks, "jpeg": image_blocks, "bmp": image_blocks, "tiff": image_blocks,
}


def extract(files: DataFrame, extractors: dict[str, Extractor] = EXTRACTORS) -> DataFrame:
    """``rel_path, block, text, error`` from files with ``rel_path, extension, content``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, extension, content in zip(batch["rel_path"], batch["extension"], batch["content"], strict=True):
                try:
                    blocks = list(extractors[extension](content))
                    out += [(path, i, text, None) for i, text in enumerate(blocks)]
                except Exception as e:  # one broken file doesn't end the scan
                    out.append((path, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["rel_path", "block", "text", "error"])

    return files.select("rel_path", "extension", "content").mapInPandas(run, "rel_path string, block int, text string, error string")
