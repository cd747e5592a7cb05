"""What cameras write into photographs: metadata of JPEG and TIFF files, from their first bytes.

A file's directories of tags are walked in either byte order. Whatever is damaged (an offset outside the bytes at hand, an
unknown type, a directory that leads back to itself) gives a null and not an error; so does a file of another kind.
"""

from __future__ import annotations

import struct

from .formats import Reader, _Documents

#: Bytes of a file that are read: metadata stand in front, in a segment of at most 64 KB.
HEAD = 160 * 1024
# Fixed values of the public Exif standard: sizes and formats of types, and the tags that are read.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii")}
SUBDIRECTORY = 0x8769
TAGS = {
    0x0100: "tiff_width", 0x0101: "tiff_height", 0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x829A: "exposure", 0x829D: "aperture",
    0x8827: "iso", 0x9003: "taken", 0x920A: "focal", 0xA002: "exif_width", 0xA003: "exif_height", 0xA20E: "plane_res_x", 0xA20F: "plane_res_y",
    0xA210: "plane_unit", 0xA405: "focal35",
}
COLUMNS = "format string, width int, height int, orig_width int, orig_height int, make string, model string, orientation int, taken string, exposure double, aperture double, iso int, focal double, focal35 double, plane_res_x double, plane_res_y double, plane_unit int"
_WHOLE = ("width", "height", "orig_width", "orig_height", "orientation", "iso", "plane_unit")


def _values(data: bytes, at: int, kind: int, count: int, order: str) -> object | None:
    """The first value of an entry (text: all of it), or None if it lies outside or is of no known type."""
    if kind not in TYPES or not 0 < count < 1 << 20:
        return None
    size, code = TYPES[kind]
    where = at + 8 if size * count <= 4 else struct.unpack_from(order + "I", data, at + 8)[0]
    if where + size * count > len(data):
        return None
    if code == "s":
        return data[where : where + count].split(b"\0")[0].decode("latin-1").strip() or None
    if len(code) == 2:
        top, bottom = struct.unpack_from(order + code, data, where)
        return top / bottom if bottom else None
    return struct.unpack_from(order + code, data, where)[0]


def tags_of(data: bytes) -> dict[str, object]:
    """Tags of a block that begins with a byte order mark; the first directory and the one that it points to."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    found: dict[str, object] = {}
    if order is None or len(data) < 8:
        return found
    todo, seen = [struct.unpack_from(order + "I", data, 4)[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        for i in range(n):
            entry = at + 2 + 12 * i
            if entry + 12 > len(data):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            if tag == SUBDIRECTORY:
                todo.append(struct.unpack_from(order + "I", data, entry + 8)[0])
            elif tag in TAGS and TAGS[tag] not in found:
                value = _values(data, entry, kind, count, order)
                if value is not None:
                    found[TAGS[tag]] = value
    return found


def photo(data: bytes) -> dict[str, object]:
    """``COLUMNS`` of a file's first bytes. Width and height are the image's, orig_ those that the camera noted."""
    tags: dict[str, object] = {}
    width = height = kind = None
    if data[:2] == b"\xff\xd8":
        kind, at = "jpeg", 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            mark = data[at + 1]
            if mark == 0xFF:  # a filling byte
                at += 1
                continue
            (size,) = struct.unpack_from(">H", data, at + 2)
            if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0" and not tags:
                tags = tags_of(data[at + 10 : at + 2 + size])
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and at + 9 <= len(data):
                height, width = struct.unpack_from(">HH", data, at + 5)
            if mark == 0xDA or size < 2:
                break
            at += 2 + size
    elif data[:4] in (b"II*\0", b"MM\0*"):
        kind, tags = "tiff", tags_of(data)
        width, height = tags.get("tiff_width"), tags.get("tiff_height")
    out = {c: tags.get(c) for c in (f.split()[0] for f in COLUMNS.split(", "))}
    out |= {"format": kind, "width": width or tags.get("exif_width"), "height": height or tags.get("exif_height"), "orig_width": tags.get("exif_width"), "orig_height": tags.get("exif_height")}
    for c, v in out.items():
        if c in ("format", "make", "model", "taken"):
            out[c] = v if isinstance(v, str) else None
        else:
            out[c] = None if v is None or isinstance(v, str) or abs(v) >= 2**31 else int(v) if c in _WHOLE else float(v)
    return out


class _Photos(Reader):
    numbers = ()
    head = HEAD

    def columns(self, data: bytes) -> dict[str, list]:
        return {c: [v] for c, v in photo(data).items()}


class PhotoMetadata(_Documents):
    """Photographs, a row each; ``dataset`` is the file's name without its ending."""

    reads, fields = _Photos, "dataset string, " + COLUMNS

    @classmethod
    def name(cls) -> str:
        return "photo_metadata"
