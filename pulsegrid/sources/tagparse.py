"""Tag parsers over file bytes: ID3v1, ID3v2, APEv2, Vorbis comments, MP4 atoms and RIFF chunks.

parse() gives (source, priority, field, value) tuples; tag_sets() maps it over binaryFile rows,
in the form that operators.tags merges.  Broken or hostile sizes end a parser early and leave a
("diagnostic", ...) tuple; nothing raises.
"""

from __future__ import annotations

import base64
import re
import struct

from pyspark.sql import DataFrame

Tag = tuple[str, int, str, str]

# The genres of ID3v1 in the order of their numbers
GENRES = (
    "Blues|Classic Rock|Country|Dance|Disco|Funk|Grunge|Hip-Hop|Jazz|Metal|New Age|Oldies|Other|Pop|R&B|Rap|Reggae|Rock|Techno|Industrial|Alternative|Ska|Death Metal|Pranks|Soundtrack|Euro-Techno|Ambient|Trip-Hop|Vocal|Jazz+Funk|"
    "Fusion|Trance|Classical|Instrumental|Acid|House|Game|Sound Clip|Gospel|Noise|AlternRock|Bass|Soul|Punk|Space|Meditative|Instrumental Pop|Instrumental Rock|Ethnic|Gothic|Darkwave|Techno-Industrial|Electronic|Pop-Folk|Eurodance|"
    "Dream|Southern Rock|Comedy|Cult|Gangsta|Top 40|Christian Rap|Pop/Funk|Jungle|Native American|Cabaret|New Wave|Psychadelic|Rave|Showtunes|Trailer|Lo-Fi|Tribal|Acid Punk|Acid Jazz|Polka|Retro|Musical|Rock & Roll|Hard Rock|"
    "Folk|Folk-Rock|National Folk|Swing|Fast Fusion|Bebob|Latin|Revival|Celtic|Bluegrass|Avantgarde|Gothic Rock|Progressive Rock|Psychedelic Rock|Symphonic Rock|Slow Rock|Big Band|Chorus|Easy Listening|Acoustic|Humour|Speech|"
    "Chanson|Opera|Chamber Music|Sonata|Symphony|Booty Bass|Primus|Porn Groove|Satire|Slow Jam|Club|Tango|Samba|Folklore|Ballad|Power Ballad|Rhythmic Soul|Freestyle|Duet|Punk Rock|Drum Solo|Acapella|Euro-House|Dance Hall|Goa|"
    "Drum & Bass|Club-House|Hardcore|Terror|Indie|BritPop|Negerpunk|Polsk Punk|Beat|Christian Gangsta|Heavy Metal|Black Metal|Crossover|Contemporary Christian|Christian Rock|Merengue|Salsa|Thrash Metal|Anime|JPop|SynthPop"
).split("|")
# Field names of frames, keys and atoms
ID3_FIELDS = {"TIT2": "title", "TPE1": "artist", "TPE2": "album_artist", "TALB": "album", "TRCK": "track", "TPOS": "disc", "TCON": "genre", "TDRC": "date", "TYER": "date", "TCOM": "composer", "TBPM": "bpm", "TSRC": "isrc", "TKEY": "key", "TENC": "encoded_by", "TCOP": "copyright", "TPUB": "publisher"}
ID3_SHORT = {"TT2": "TIT2", "TP1": "TPE1", "TP2": "TPE2", "TAL": "TALB", "TRK": "TRCK", "TPA": "TPOS", "TCO": "TCON", "TYE": "TYER", "TCM": "TCOM", "TBP": "TBPM", "COM": "COMM", "ULT": "USLT", "TXX": "TXXX", "PIC": "APIC", "RVA": "RVA2"}
KEYS = {"TITLE": "title", "ARTIST": "artist", "ALBUMARTIST": "album_artist", "ALBUM ARTIST": "album_artist", "ALBUM": "album", "TRACKNUMBER": "track", "TRACK": "track", "DISCNUMBER": "disc", "DISC": "disc", "GENRE": "genre", "DATE": "date", "YEAR": "date", "COMPOSER": "composer", "BPM": "bpm", "ISRC": "isrc", "COMMENT": "comment", "DESCRIPTION": "comment", "LYRICS": "lyrics", "CUESHEET": "cuesheet", "COPYRIGHT": "copyright", "REPLAYGAIN_TRACK_GAIN": "track_gain", "REPLAYGAIN_TRACK_PEAK": "track_peak", "REPLAYGAIN_ALBUM_GAIN": "album_gain", "REPLAYGAIN_ALBUM_PEAK": "album_peak"}
ATOMS = {b"\xa9nam": "title", b"\xa9ART": "artist", b"aART": "album_artist", b"\xa9alb": "album", b"\xa9gen": "genre", b"\xa9day": "date", b"\xa9wrt": "composer", b"\xa9cmt": "comment", b"\xa9lyr": "lyrics", b"cprt": "copyright", b"\xa9too": "encoded_by"}
INFO = {b"INAM": "title", b"IART": "artist", b"IPRD": "album", b"IGNR": "genre", b"ICRD": "date", b"ICMT": "comment", b"ITRK": "track", b"ICOP": "copyright", b"ISFT": "encoded_by"}
PRIORITY = {"id3v2": 0, "apev2": 1, "id3v1": 2}


def decoded(raw: bytes, encoding: int) -> str:
    """Text of an ID3 encoding byte; bytes labelled Latin-1 that are UTF-8 with a multi-byte character are read as that."""
    if encoding in (1, 2):
        if encoding == 1 and raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return raw[2:].decode("utf-16-le" if raw[0] == 0xFF else "utf-16-be", "replace")
        return raw.decode("utf-16-be" if encoding == 2 else "utf-16-le", "replace")
    if encoding == 3 or any(b >= 0x80 for b in raw):
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


def parts(text: str) -> list[str]:
    return [p for p in text.split("\0") if p]


def _syncsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def id3v1(data: bytes) -> list[Tag]:
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return []
    t = data[-128:]
    text = lambda a, z: decoded(t[a:z].split(b"\0")[0], 0).rstrip()
    out = [("title", text(3, 33)), ("artist", text(33, 63)), ("album", text(63, 93)), ("date", text(93, 97)), ("comment", text(97, 127))]
    if t[125] == 0 and t[126]:
        out[-1] = ("comment", text(97, 125))
        out.append(("track", str(t[126])))
    if t[127] < len(GENRES):
        out.append(("genre", GENRES[t[127]]))
    return [("id3v1", PRIORITY["id3v1"], f, v) for f, v in out if v]


def _split_described(body: bytes, encoding: int) -> tuple[bytes, bytes]:
    if encoding in (1, 2):
        for i in range(0, len(body) - 1, 2):
            if body[i : i + 2] == b"\0\0":
                return body[:i], body[i + 2 :]
        return body, b""
    a, _, z = body.partition(b"\0")
    return a, z


def id3v2(data: bytes) -> list[Tag]:
    src, pri = "id3v2", PRIORITY["id3v2"]
    if len(data) < 10 or data[:3] != b"ID3":
        return []
    version, flags, size = data[3], data[5], _syncsafe(data[6:10])
    if version not in (2, 3, 4):
        return [(src, pri, "diagnostic", f"unsupported version {version}")]
    body = data[10 : 10 + size]
    out: list[Tag] = [] if len(body) == size else [(src, pri, "diagnostic", "tag is longer than the file")]
    if version > 2 and flags & 0x40 and len(body) >= 4:
        body = body[4 + struct.unpack(">I", body[:4])[0] :] if version == 3 else body[_syncsafe(body[:4]) :]
    if flags & 0x80:
        body = body.replace(b"\xff\0", b"\xff")
    head, at, seen = (6 if version == 2 else 10), 0, set()

    def put(field: str, value: str) -> None:
        if value and field not in seen:
            seen.add(field)
            out.append((src, pri, field, value))

    while at + head <= len(body) and body[at]:
        name = body[at : at + (3 if version == 2 else 4)].decode("latin-1")
        n = int.from_bytes(body[at + 3 : at + 6], "big") if version == 2 else _syncsafe(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
        name = ID3_SHORT.get(name, name) if version == 2 else name
        raw = body[at + head : at + head + n]
        if len(raw) < n:
            out.append((src, pri, "diagnostic", f"frame {name} is longer than the tag"))
            break
        at += head + n
        if not raw:
            continue
        enc = raw[0]
        if name == "TXXX":
            d, v = _split_described(raw[1:], enc)
            key = decoded(d, enc)
            put(KEYS.get(key.upper(), f"TXXX:{key}"), "; ".join(parts(decoded(v, enc))))
        elif name in ("COMM", "USLT") and len(raw) > 4:
            _, v = _split_described(raw[4:], enc)
            put("comment" if name == "COMM" else "lyrics", decoded(v, enc).rstrip("\0"))
        elif name == "RVA2":
            ident, _, rest = raw.partition(b"\0")
            if len(rest) >= 3:
                put("track_gain", f"{struct.unpack('>h', rest[1:3])[0] / 512:.6g} dB")
        elif name == "APIC":
            mime = raw[1:].partition(b"\0")[0].decode("latin-1")
            put("picture", f"{mime} {len(raw)} bytes")
        elif name == "CHAP":
            ident, _, rest = raw.partition(b"\0")
            if len(rest) >= 16:
                label = rest[16 + 11 :].split(b"\0")[0].decode("latin-1") if rest[16:20] == b"TIT2" else ident.decode("latin-1")
                out.append((src, pri, "cue_point", f"{struct.unpack('>I', rest[:4])[0] / 1000:.3f} {label}"))
        elif name[0] in "TW":
            value = "; ".join(parts(decoded(raw[1:], enc))) if name[0] == "T" else decoded(raw, 0)
            genre = re.fullmatch(r"\(?(\d{1,3})\)?", value) if name == "TCON" else None
            put(ID3_FIELDS.get(name, name), GENRES[int(genre[1])] if genre and int(genre[1]) < len(GENRES) else value)
        else:
            put(name, f"<{len(raw)} binary bytes>")
    return out


def apev2(data: bytes) -> list[Tag]:
    src, pri = "apev2", PRIORITY["apev2"]
    end = len(data) - (128 if data[-128:-125] == b"TAG" else 0)
    foot = data[end - 32 : end] if end >= 32 else b""
    if foot[:8] != b"APETAGEX":
        return []
    _, size, count, flags = struct.unpack("<IIII", foot[8:24])
    if flags & (1 << 29) or size < 32 or size > end:
        return [(src, pri, "diagnostic", "implausible size")]
    at, out = end - size, []
    for _ in range(count):
        if at + 8 > end - 32:
            break
        n, item = struct.unpack("<II", data[at : at + 8])
        stop = data.find(b"\0", at + 8, end)
        if stop < 0 or stop + 1 + n > end - 32:
            out.append((src, pri, "diagnostic", "item is longer than the tag"))
            break
        key, value = data[at + 8 : stop].decode("latin-1"), data[stop + 1 : stop + 1 + n]
        at = stop + 1 + n
        if item >> 1 & 3 == 0:
            text = parts(value.decode("utf-8", "replace"))
            if text:
                out.append((src, pri, KEYS.get(key.upper(), key), text[0]))
    return out


def vorbis(body: bytes, src: str) -> list[Tag]:
    out: list[Tag] = []
    try:
        at = 4 + struct.unpack_from("<I", body)[0]
        count = struct.unpack_from("<I", body, at)[0]
        at += 4
        for _ in range(count):
            n = struct.unpack_from("<I", body, at)[0]
            if at + 4 + n > len(body):
                raise struct.error
            entry = body[at + 4 : at + 4 + n].decode("utf-8", "replace")
            at += 4 + n
            key, eq, value = entry.partition("=")
            if eq:
                key = key.upper()
                if key == "METADATA_BLOCK_PICTURE":
                    clean = re.match(r"[A-Za-z0-9+/]*", re.sub(r"[\s=]", "", value))[0]
                    out.append((src, 0, "picture", f"{len(base64.b64decode(clean + '=' * (-len(clean) % 4)))} bytes"))
                elif value:
                    out.append((src, 0, KEYS.get(key, key), value))
    except (struct.error, ValueError):
        out.append((src, 0, "diagnostic", "truncated comments"))
    return out


def flac(data: bytes) -> list[Tag]:
    at, out = data.find(b"fLaC") + 4, []
    rate = 0
    while at + 4 <= len(data):
        last, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if kind == 0 and len(body) >= 18:
            rate = int.from_bytes(body[10:13], "big") >> 4
        elif kind == 4:
            out += vorbis(body, "flac")
        elif kind == 5 and len(body) >= 396 and rate:
            p = 396
            for _ in range(body[395]):
                if p + 36 > len(body):
                    break
                number, points = body[p + 8], body[p + 35]
                if number not in (170, 255):
                    out.append(("flac", 0, "cue_point", f"{int.from_bytes(body[p : p + 8], 'big') / rate:.3f} Track {number}"))
                p += 36 + 12 * points
        elif kind == 6:
            out.append(("flac", 0, "picture", f"{n} bytes"))
        at += 4 + n
        if last:
            break
    return out


def ogg(data: bytes) -> list[Tag]:
    packets, now, at = [], b"", 0
    while at + 27 <= len(data) and data[at : at + 4] == b"OggS" and len(packets) < 2:
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        at += 27 + n
        for size in lacing:
            now += data[at : at + size]
            at += size
            if size < 255:
                packets.append(now)
                now = b""
    if len(packets) >= 2 and packets[1][:7] == b"\x03vorbis":
        return vorbis(packets[1][7:], "ogg")
    return []


def _boxes(data: bytes, at: int, end: int):
    while at + 8 <= end:
        n, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if n == 1 and at + 16 <= end:
            n, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        n = end - at if n == 0 else n
        if n < head or at + n > end:
            return
        yield kind, at + head, at + n
        at += n


def _box(data: bytes, at: int, end: int, kind: bytes):
    return next(((a, z) for k, a, z in _boxes(data, at, end) if k == kind), None)


def mp4(data: bytes) -> list[Tag]:
    moov = _box(data, 0, len(data), b"moov")
    udta = moov and _box(data, *moov, b"udta")
    meta = udta and _box(data, *udta, b"meta")
    ilst = udta and (_box(data, *udta, b"ilst") or meta and _box(data, meta[0] + 4, meta[1], b"ilst"))
    out: list[Tag] = []
    for kind, a, z in _boxes(data, *ilst) if ilst else ():
        found = _box(data, a, z, b"data")
        if not found or found[1] - found[0] < 8:
            continue
        body = data[found[0] + 8 : found[1]]
        if kind in (b"trkn", b"disk") and len(body) >= 6:
            no, total = struct.unpack_from(">HH", body, 2)
            out.append(("mp4", 0, "track" if kind == b"trkn" else "disc", f"{no}/{total}" if total else str(no)))
        elif kind == b"covr":
            out.append(("mp4", 0, "picture", f"{len(body)} bytes"))
        elif kind == b"----":
            name = _box(data, a, z, b"name")
            key = data[name[0] + 4 : name[1]].decode("utf-8", "replace") if name else "----"
            out.append(("mp4", 0, KEYS.get(key.upper(), key), body.decode("utf-8", "replace")))
        elif body:
            out.append(("mp4", 0, ATOMS.get(kind, kind.decode("latin-1")), body.decode("utf-8", "replace")))
    return out


def riff(data: bytes) -> list[Tag]:
    out: list[Tag] = []
    rate, cues, labels = 0, {}, {}
    at = 12

    def text(b: bytes) -> str:
        return decoded(b.split(b"\0")[0], 0).strip()

    while at + 8 <= len(data):
        tag, n = struct.unpack_from("<4sI", data, at)
        body = data[at + 8 : at + 8 + n]
        if tag == b"fmt " and len(body) >= 8:
            rate = struct.unpack_from("<I", body, 4)[0]
        elif tag == b"LIST" and body[:4] == b"INFO":
            p = 4
            while p + 8 <= len(body):
                k, m = struct.unpack_from("<4sI", body, p)
                v = text(body[p + 8 : p + 8 + m])
                if v:
                    out.append(("riff", 0, INFO.get(k, k.decode("latin-1")), v))
                p += 8 + m + (m & 1)
        elif tag == b"LIST" and body[:4] == b"adtl":
            p = 4
            while p + 8 <= len(body):
                k, m = struct.unpack_from("<4sI", body, p)
                if k == b"labl" and p + 12 > len(body):
                    out.append(("diagnostic", 0, "labl", "label cut short"))
                elif k == b"labl" and m >= 4:
                    labels[struct.unpack_from("<I", body, p + 8)[0]] = text(body[p + 12 : p + 8 + m])
                p += 8 + m + (m & 1)
        elif tag == b"cue " and len(body) >= 4:
            for i in range(min(struct.unpack_from("<I", body)[0], (len(body) - 4) // 24)):
                ident, _, _, _, _, offset = struct.unpack_from("<IIIIII", body, 4 + 24 * i)
                cues[ident] = offset
        elif tag == b"bext" and len(body) >= 348:
            for field, a, z in (("description", 0, 256), ("originator", 256, 288), ("originator_reference", 288, 320), ("date", 320, 330), ("time", 330, 338)):
                if text(body[a:z]):
                    out.append(("riff", 0, field, text(body[a:z])))
            if len(body) >= 414 and struct.unpack_from("<H", body, 346)[0] >= 1:
                out.append(("riff", 0, "integrated_lufs", f"{struct.unpack_from('<h', body, 412)[0] / 100:.2f}"))
        elif tag in (b"id3 ", b"ID3 "):
            out += id3v2(body)
        elif tag == b"iXML":
            out.append(("riff", 0, "ixml", body[: 16 * 1024].decode("utf-8", "replace")))
        at += 8 + n + (n & 1)
    for ident in sorted(cues):
        out.append(("riff", 0, "cue_point", f"{cues[ident] / rate if rate else 0:.3f} {labels.get(ident) or f'Cue {ident}'}"))
    return out


def parse(data: bytes) -> list[Tag]:
    """Tags of a file: the container's own, else ID3v2, APEv2 and ID3v1 by priority."""
    skip = 10 + _syncsafe(data[6:10]) if data[:3] == b"ID3" and len(data) >= 10 else 0
    head = data[skip : skip + 12]
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        return riff(data[skip:])
    if head[:4] == b"fLaC":
        return flac(data[skip:])
    if head[:4] == b"OggS":
        return ogg(data[skip:])
    if head[4:8] == b"ftyp":
        return mp4(data[skip:])
    return id3v2(data) + apev2(data) + id3v1(data)


def tag_sets(files: DataFrame) -> DataFrame:
    """(file, priority, source, field, value) from binaryFile rows (path, content)."""
    schema = "file string, priority int, source string, field string, value string"

    def run(batches):
        import pandas as pd

        for df in batches:
            rows = [(path, p, s, f, v) for path, c in zip(df["path"], df["content"], strict=True) if c is not None for s, p, f, v in parse(bytes(c))]
            yield pd.DataFrame(rows, columns=["file", "priority", "source", "field", "value"]).astype({"priority": "int32"})

    return files.select("path", "content").mapInPandas(run, schema)
