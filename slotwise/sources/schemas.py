"""Schemas of the documents that are read; nothing is inferred."""

EXTRACTION = """source struct<path: string, sha256: string, bytes: bigint>, extractor struct<name: string, version: string, scriptHash: string>,
 page struct<index: int, count: int, view: array<double>>, imageOnly boolean,
 runs array<struct<i: int, x: double, y: double, w: double, h: double, text: string, font: string, size: double>>,
 rects array<struct<i: int, x: double, y: double, w: double, h: double, fill: string, op: string>>"""

DIAGNOSTIC = "struct<severity: string, code: string, sourcePath: string, subject: string, detail: string, suggestion: string>"

PARSED = f"""kind string, sourcePath string, layoutFamily string, extractionMethod string, programme string, semester string, fillerCount int,
 sessions array<struct<rawName: string, weekday: int, startMin: int, endMin: int, room: string, elective: boolean, validity: struct<label: string, `from`: string, `to`: string>, spanSource: string, spanMargin: double>>,
 exams array<struct<rawName: string, date: string, startMin: int, endMin: int, durationSource: string, slotLabel: string, room: string, semester: string>>,
 diagnostics array<{DIAGNOSTIC}>"""

VISION_TIMETABLE = """kind string, source string, grids array<struct<semester: string, columns: array<string>, rows: array<struct<weekday: string, blocks: array<struct<name: string, start: string, `end`: string, room: string, elective: boolean>>>>>>"""

GUIDES = "year string, verified array<string>, languages map<string, array<string>>"
BUNDLE = """schemaVersion int, builtAt string, courses array<struct<key: string, name: string, progs: array<string>, elective: boolean,
 sessions: array<struct<prog: string, sem: string, d: int, s: int, e: int, room: string, v: struct<label: string, `from`: string, `to`: string>, inferred: boolean, vision: boolean>>,
 exams: array<struct<date: string, s: int, e: int, room: string, slot: string, assumed: boolean, witnesses: int, progs: array<string>>>>>"""

#: The catalogue's columns, by the name in the header and the name here.
CATALOGUE = {"plans": "plans", "codes": "codes", "name": "name", "english name": "english_name", "year": "year", "credits": "credits", "language": "language", "semester": "semester", "group": "grp", "level": "level", "quota": "quota", "learning guide": "learning_guide", "observations": "observations"}
