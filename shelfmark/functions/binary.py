"""File type and file health from bytes, as expressions over ``binary`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .lookup import bare_ext, first_case, lookup


#: Bytes of a file that its type is told from.
HEAD_BYTES = 64


def file_type(content: Column, ext: Column, members: Column | None = None) -> Column:
    """Struct of extension, mime and detection method from the first 64 bytes, archive member names
    (when given) and the extension, in this order."""
    head = F.substring(content, 1, HEAD_BYTES)
    plain = bare_ext(ext)

    def found(kind: str, mime: str | None, how: str) -> Column:
        return F.struct(F.lit(kind).alias("extension"),
                        F.lit(mime or "application/octet-stream").alias("mime"), F.lit(how).alias("method"))

    by_name = F.struct(F.when(plain != "", plain).otherwise("unknown").alias("extension"),
                       F.lit("application/octet-stream").alias("mime"),
                       F.when(plain != "", "extension").otherwise("unknown").alias("method"))

    def inside(needle: bytes, first: int) -> Column:
        return F.substring(head, first + 1, len(needle)) == F.lit(needle)

    cases = []
    for prefix, kind, mime in V.MAGIC:
        hit = F.startswith(head, F.lit(prefix))
        if kind == "zip_based":
            if members is not None:
                names = F.array_join(members, "\n")
                cases += [(hit & names.contains(part), found(e, t, "container")) for part, e, t in V.ZIP_MEMBERS]
            cases.append((hit, found("zip", "application/zip", "magic")))
        elif kind == "ole2":
            cases += [(hit & F.contains(head, F.lit(text)), found(e, t, "container"))
                      for text, e, t in V.OLE_STRINGS]
            cases.append((hit, found("ole2", None, "magic")))
        elif kind == "riff":
            cases += [(hit & inside(text, 8), found(e, t, "container")) for text, e, t in V.RIFF_TYPES]
            cases.append((hit, found("riff", None, "magic")))
        else:
            cases.append((hit, found(kind, mime, "magic")))
    # the marker may start at any byte of the first 32; byte positions, so that no half byte can match
    starts = F.filter(F.sequence(F.lit(1), F.lit(29)), lambda i: F.substr(head, i, F.lit(4)) == F.lit(b"ftyp"))
    brand = F.substr(head, F.get(starts, 0) + F.lit(4), F.lit(4))
    ftyp = F.size(starts) > 0
    cases += [(ftyp & (brand == F.lit(code)), found(e, t, "container")) for code, e, t in V.FTYP_BRANDS]
    cases.append((ftyp, found("mp4", "video/mp4", "container")))
    return first_case(cases, by_name)


def file_health(content: Column, size: Column, ext: Column, zip_ok: Column | None = None) -> Column:
    """Struct of validity, error codes, warning codes and health. A null size is a missing file; give
    ``zip_ok`` from the archive manifest to report broken archives."""
    plain = bare_ext(ext)
    head = F.substring(content, 1, HEAD_BYTES)
    expected = lookup(plain, V.EXPECTED_HEADER)
    mismatch = expected.isNotNull() & ~F.startswith(head, expected)
    is_pdf, is_zip = plain == "pdf", plain.isin("zip", "docx", "xlsx", "pptx")
    tail = F.substr(content, F.greatest(F.lit(1), F.length(content) - 1023), F.lit(1024))
    listing_broken = F.lit(False) if zip_ok is None else ~F.coalesce(zip_ok, F.lit(True))
    codes = F.array(
        F.when(is_pdf & ~F.startswith(head, F.lit(b"%PDF")), "PDF_INVALID_HEADER"),
        F.when(is_pdf & F.contains(content, F.lit(bytearray(b"/Encrypt"))), "PDF_ENCRYPTED"),
        F.when(is_pdf & ~F.contains(tail, F.lit(bytearray(b"%%EOF"))), "PDF_TRUNCATED"),
        F.when(is_zip & listing_broken, "ZIP_CORRUPTED"))
    errors = F.when(size.isNull(), F.array(F.lit("FILE_NOT_FOUND"))).when(size == 0, F.array(F.lit("EMPTY_FILE"))).otherwise(
        F.filter(codes, lambda c: c.isNotNull()))
    present = size.isNotNull() & (size > 0)
    warnings = F.filter(F.array(
        F.when(present & (size < 10), "SUSPICIOUSLY_SMALL"), F.when(present & mismatch, "MAGIC_MISMATCH")),
        lambda c: c.isNotNull())
    health = (F.when(size.isNull(), "missing").when(size == 0, "empty").when(F.size(errors) > 0, "corrupted")
              .when(mismatch, "mislabeled").otherwise("healthy"))
    return F.struct((F.size(errors) == 0).alias("valid"), errors.alias("errors"), warnings.alias("warnings"),
                    health.alias("health"))
