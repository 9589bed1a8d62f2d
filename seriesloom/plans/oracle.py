"""The queries as plain SQL for an independent engine.

Written against the definitions and not against the Spark code: the theta join is a theta join
here, numbering is one window, and the answers of the model fixtures come from the columns they
were built from.
"""

from __future__ import annotations

from seriesloom.plans.views import ASKING_SQL, CATALOG_RULES_SQL, PATHS_SQL, SERIES_SQL

# Fixed values of the standard, written out here so that a slip in the implementation shows.
EXTENSIONS = [".nii.gz", ".nii", ".json", ".tsv", ".bval", ".bvec"]
MRI_DATATYPES = ["anat", "func", "fmap", "dwi", "perf"]
DATATYPE_SUFFIXES = {
    "anat": ["T1w", "T2w", "FLAIR"],
    "func": ["bold"],
    "fmap": ["magnitude", "phasediff", "fieldmap"],
    "dwi": ["dwi"],
    "perf": ["asl"],
}
# Long and short names in the standard's order.
ENTITY_SHORT = {
    "subject": "sub",
    "session": "ses",
    "task": "task",
    "acquisition": "acq",
    "run": "run",
    "echo": "echo",
    "direction": "dir",
    "reconstruction": "rec",
    "space": "space",
    "description": "desc",
}
ENTITY_ORDER = list(ENTITY_SHORT)
DATATYPE_ENTITIES = {
    "anat": ["subject", "session", "acquisition", "run", "reconstruction"],
    "func": ["subject", "session", "acquisition", "run", "reconstruction", "task", "echo"],
    "fmap": ["subject", "session", "acquisition", "run", "reconstruction", "direction"],
    "dwi": ["subject", "session", "acquisition", "run", "reconstruction", "direction"],
    "perf": ["subject", "session", "acquisition", "run", "reconstruction"],
}

KEYS = (
    "protocol_name, series_description, sequence_name, dim1, dim2, dim3, dim4, TR, TE, "
    "is_derived, is_motion_corrected, image_type"
)
_TEXT_KEYS = ("protocol_name", "series_description", "sequence_name", "image_type")


def _number(column: str) -> str:
    return f"COALESCE(TRY_CAST({column} AS DOUBLE), 0)"


COERCED = f"""
SELECT series_id, row_ord, subject, session, 'study' AS study, protocol_name, series_description,
  sequence_name, {_number('dim1')} AS dim1, {_number('dim2')} AS dim2, {_number('dim3')} AS dim3,
  {_number('dim4')} AS dim4, COALESCE(TR, 0) AS TR, COALESCE(TE, 0) AS TE,
  COALESCE(is_derived, false) AS is_derived,
  COALESCE(is_motion_corrected, false) AS is_motion_corrected, image_type,
  series_files, example_dcm_file, dcm_dir_name
FROM series"""


def _json_field(key: str) -> str:
    value = f"""'"' || {key} || '"'""" if key in _TEXT_KEYS else f"CAST({key} AS VARCHAR)"
    return f"""'"{key}":' || {value}"""


_GROUP_ID = (
    """sha256('{"study":"study",' || """
    + " || ',' || ".join(_json_field(k) for k in KEYS.split(", "))
    + " || '}')"
)


def _first(column: str, name: str | None = None) -> str:
    return (
        f"arg_min({column}, row_ord) FILTER (WHERE {column} IS NOT NULL) AS {name or column}"
    )


def _grouped(source: str) -> str:
    return f"""
SELECT study, {KEYS}, CAST(count(series_id) AS BIGINT) AS series_count,
  {_first('series_id', 'representative_series_id')},
  CAST(COALESCE(sum(series_files), 0) AS BIGINT) AS total_files,
  {_first('series_files', 'representative_files')}, {_first('example_dcm_file')},
  {_first('dcm_dir_name')}, {_first('subject')}, {_first('session')}
FROM {source} GROUP BY ALL"""


GROUPS = f"""
SELECT *, {_GROUP_ID} AS group_id FROM ({_grouped('''coerced WHERE protocol_name IS NOT NULL
  AND series_description IS NOT NULL AND sequence_name IS NOT NULL AND image_type IS NOT NULL''')}
)"""

NUMBERED = """
SELECT *, row_number() OVER (PARTITION BY study ORDER BY series_count DESC, group_id) AS group_no,
  CAST((row_number() OVER (PARTITION BY study ORDER BY series_count DESC, group_id) - 1) // 10
    AS BIGINT) AS batch_id,
  CAST((row_number() OVER (PARTITION BY study ORDER BY series_count DESC, group_id) - 1) % 10
    AS INTEGER) AS pos
FROM groups"""

_FALLBACK_TEXT = "lower(protocol_name || series_description)"
MAPPED = f"""
SELECT *,
  CASE WHEN bids_suffix IN ('T1w', 'T2w') THEN 'anat' WHEN bids_suffix = 'bold' THEN 'func'
    ELSE 'unknown' END AS bids_modality,
  CASE WHEN bids_suffix = 'bold' THEN 'task=unknown' ELSE '' END AS bids_entities,
  CASE WHEN bids_suffix = 'unknown' THEN 0.3e0 ELSE 0.6e0 END AS bids_confidence,
  CASE bids_suffix WHEN 'T1w' THEN 'anat/sub-{{subject}}_ses-{{session}}_T1w'
    WHEN 'T2w' THEN 'anat/sub-{{subject}}_ses-{{session}}_T2w'
    WHEN 'bold' THEN 'func/sub-{{subject}}_ses-{{session}}_task-unknown_bold'
    ELSE 'unmapped' END AS bids_path,
  'fallback' AS mapping_source,
  bids_suffix <> 'unknown' AS suffix_valid
FROM (SELECT *, CASE
    WHEN regexp_matches({_FALLBACK_TEXT}, 't1|mprage|anatomical') THEN 'T1w'
    WHEN regexp_matches({_FALLBACK_TEXT}, 't2|flair') THEN 'T2w'
    WHEN regexp_matches({_FALLBACK_TEXT}, 'bold|fmri|functional') THEN 'bold'
    ELSE 'unknown' END AS bids_suffix
  FROM numbered)"""

_TEXT = (
    "lower(COALESCE(series_description, '') || ' ' || COALESCE(protocol_name, '') || ' ' || "
    "COALESCE(sequence_name, ''))"
)
CLASSIFIED = f"""
SELECT series_id,
  CASE WHEN modality = 'anat' AND dim4 > 1 THEN 'func' ELSE modality END AS modality,
  CASE WHEN modality = 'anat' AND dim4 > 1 THEN 'bold' ELSE suffix END AS suffix,
  task, direction,
  CASE WHEN (modality = 'func' OR (modality = 'anat' AND dim4 > 1)) AND (dim1 >= 512 OR dim2 >= 512)
    THEN greatest(0.3e0, confidence - 0.2e0) ELSE confidence END AS confidence
FROM (
  SELECT series_id, dim1, dim2, dim4,
    CASE branch WHEN 'T1' THEN 'anat' WHEN 'T2' THEN 'anat' WHEN 'F' THEN 'func'
      WHEN 'D' THEN 'dwi' WHEN 'M' THEN 'fmap' WHEN 'P' THEN 'perf' ELSE 'mri' END AS modality,
    CASE branch WHEN 'T1' THEN 'T1w'
      WHEN 'T2' THEN CASE WHEN contains(text, 'flair') THEN 'FLAIR' ELSE 'T2w' END
      WHEN 'F' THEN 'bold' WHEN 'D' THEN 'dwi'
      WHEN 'M' THEN CASE WHEN contains(text, 'magnitude') THEN 'magnitude'
        WHEN contains(text, 'phase') THEN 'phasediff' ELSE 'fieldmap' END
      WHEN 'P' THEN 'asl' ELSE 'T1w' END AS suffix,
    CASE WHEN branch = 'F' AND contains(text, 'rest') THEN 'rest'
      WHEN branch = 'F' AND contains(text, 'task') THEN COALESCE(NULLIF(
        regexp_extract(text, '(?:^|\\s)\\S*task\\S*\\s+(\\S+)', 1), ''), 'unknown') END AS task,
    CASE WHEN branch = 'D' AND regexp_matches(text, 'ap|anterior|posterior') THEN 'AP'
      WHEN branch = 'D' AND contains(text, 'pa') THEN 'PA' END AS direction,
    CASE branch WHEN 'M' THEN 0.8e0 WHEN '-' THEN 0e0 ELSE 0.9e0 END AS confidence
  FROM (SELECT *, CASE
      WHEN regexp_matches(text, 't1|mprage|anatomy') THEN 'T1'
      WHEN regexp_matches(text, 't2|space|cube') THEN 'T2'
      WHEN regexp_matches(text, 'bold|fmri|func|rest|task') THEN 'F'
      WHEN regexp_matches(text, 'dwi|dti|diffusion|tensor') THEN 'D'
      WHEN regexp_matches(text, 'fieldmap|field|b0|shim') THEN 'M'
      WHEN regexp_matches(text, 'asl|perfusion|pcasl|pasl') THEN 'P' ELSE '-' END AS branch
    FROM (SELECT *, {_TEXT} AS text FROM coerced)))"""

PARSED = """
SELECT *, string_split(path, '/')[-2] AS datatype, string_split(stem, '_')[-1] AS suffix,
  list_filter(string_split(stem, '_')[:-2], lambda x: contains(x, '-')) AS entity_parts
FROM (SELECT *, string_split(string_split(path, '/')[-1], '.')[1] AS stem FROM paths)"""


def _values(rows: list[tuple], columns: str) -> str:
    def literal(value) -> str:
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


SUFFIXES = _values(
    [(d, s, i) for d, names in DATATYPE_SUFFIXES.items() for i, s in enumerate(names)],
    "datatype, suffix, pos",
)
ENTITIES = _values(
    [
        (d, e, ENTITY_SHORT[e], i)
        for d, names in DATATYPE_ENTITIES.items()
        for i, e in enumerate(names)
    ],
    "datatype, entity, short_name, pos",
)
SHORT = _values(
    [(e, ENTITY_SHORT[e], i) for i, e in enumerate(ENTITY_ORDER)],
    "entity, short_name, pos",
)

# Many studies: one per protocol and sequence.
_STUDY = "protocol_name || '/' || COALESCE(sequence_name, 'none')"
_MANY_STUDIES = f"""
SELECT {_STUDY} AS study, {KEYS}, count(*) AS n FROM coerced
WHERE protocol_name IS NOT NULL AND series_description IS NOT NULL
  AND sequence_name IS NOT NULL AND image_type IS NOT NULL GROUP BY ALL"""
_STUDY_SOURCES = f"""
SELECT s.study, CASE WHEN COALESCE(bool_or(regexp_matches({_FALLBACK_TEXT},
    't1|mprage|anatomical|t2|flair|bold|fmri|functional')), false) THEN 'rules'
  WHEN count(g.study) > 10 THEN 'model' ELSE 'catch_all' END AS source
FROM (SELECT DISTINCT {_STUDY} AS study FROM series) s
LEFT JOIN many_studies g ON g.study = s.study GROUP BY s.study"""

CTES = {
    "many_studies": _MANY_STUDIES,
    "study_sources": _STUDY_SOURCES,
    "series": SERIES_SQL,
    "paths": PATHS_SQL,
    "coerced": COERCED,
    "groups": GROUPS,
    "numbered": NUMBERED,
    "mapped": MAPPED,
    "classified": CLASSIFIED,
    "parsed": PARSED,
    "ingested": """SELECT * REPLACE (series_id % 50 AS series_id), lpad(CAST(series_id % 50 AS VARCHAR),
  20, '0') || chr(1) || subject || chr(1) || session || chr(1) || dcm_dir_name || chr(1)
  || example_dcm_file AS o
FROM coerced WHERE protocol_name IS NOT NULL AND series_description IS NOT NULL
  AND sequence_name IS NOT NULL AND image_type IS NOT NULL""",
    "suffixes": SUFFIXES,
    "entities": ENTITIES,
    "short_names": SHORT,
    "catalog_rules": f"""
SELECT version, r.*, ['sub'] || CASE WHEN has_task THEN ['task'] ELSE [] END
  || CASE WHEN has_run THEN ['run'] ELSE [] END || CASE WHEN has_acq THEN ['acq'] ELSE [] END AS allowed
FROM ({CATALOG_RULES_SQL}) r, (VALUES ('1.9.0'), ('1.10.0')) v(version)
WHERE in_first OR version = '1.10.0'""",
    "rule_sets": "SELECT DISTINCT version, datatype, suffix, allowed FROM catalog_rules",
    "rule_entities": "SELECT DISTINCT version, datatype, unnest(allowed) AS name FROM catalog_rules",
    # File names are subject, entities and suffix; "1.10.0" is the later of the two versions.
    "asking": f"""
SELECT path_id, datatype, suffix, list_sort(list_transform(parts[:-2], lambda x: string_split(x, '-')[1])) AS keys,
  CASE WHEN asked IN ('1.9.0', '1.10.0') THEN asked WHEN asked = '2.0.0' THEN NULL ELSE '1.10.0' END
  AS version
FROM (SELECT path_id, asked, string_split(path, '/')[2] AS datatype, string_split(file, '_') AS parts,
    string_split(file, '_')[-1] AS suffix
  FROM (SELECT *, replace(string_split(path, '/')[3], '.nii.gz', '') AS file FROM ({ASKING_SQL})))""",
}
# Which tables each table reads.
NEEDS = {
    "coerced": ["series"],
    "groups": ["coerced"],
    "numbered": ["groups"],
    "ingested": ["coerced"],
    "many_studies": ["coerced"],
    "study_sources": ["many_studies"],
    "mapped": ["numbered"],
    "classified": ["coerced"],
    "parsed": ["paths"],
    "rule_sets": ["catalog_rules"],
    "rule_entities": ["catalog_rules"],
}


def _with(tables: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for table in tables:
        add(table)
    parts = [f"{name} AS ({CTES[name]})" for name in ordered]
    parts += [f"{name} AS ({text})" for name, text in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}"


# --- conformance ----------------------------------------------------------------------------------


def _listed(names: list[str]) -> str:
    return "[" + ", ".join(names) + "]"


def _validate(known: list[str], entity_names: list[str]) -> str:
    in_known = ", ".join(f"'{n}'" for n in known)
    in_names = ", ".join(f"'{n}'" for n in entity_names)
    valid_list = " ".join(
        f"WHEN '{d}' THEN '{_listed(s)}'" for d, s in DATATYPE_SUFFIXES.items()
    )
    suffix_ok = " OR ".join(
        f"(datatype = '{d}' AND suffix = '{s}')"
        for d, names in DATATYPE_SUFFIXES.items()
        for s in names
    )
    endings = " OR ".join(f"ends_with(path, '{e}')" for e in EXTENSIONS)
    return _with(
        ["parsed"],
        f"""SELECT path_id, starts_with(path, 'sub-') AS valid,
  CASE WHEN starts_with(path, 'sub-') THEN ''
    ELSE 'subject: no sub- directory at the start' END AS errors,
  concat_ws('; ',
    CASE WHEN datatype NOT IN ({in_known}) THEN 'datatype: ' || datatype
      || ' is none of {_listed(known)}' END,
    CASE WHEN NOT ({endings}) THEN 'extension: none that is known ends '
      || string_split(path, '/')[-1] END,
    CASE WHEN NOT ({suffix_ok}) THEN 'suffix: ' || suffix || ' is not used with '
      || datatype || ', which has ' || CASE datatype {valid_list} ELSE '[]' END END,
    NULLIF(array_to_string(list_transform(
      list_filter(entity_parts, lambda x: string_split(x, '-')[1] NOT IN ({in_names})),
      lambda x: 'entity: ' || string_split(x, '-')[1] || ' is unknown'), '; '), '')
  ) AS warnings,
  array_to_string(list_sort(list_transform(entity_parts, lambda x: replace(x, '-', '='))), ',')
    AS entities
FROM parsed""",
    )


def _pattern_rows(combined: bool) -> list[tuple[str, str, str, str, str]]:
    from itertools import combinations

    rows = []
    for datatype, suffixes in DATATYPE_SUFFIXES.items():
        free = [e for e in DATATYPE_ENTITIES[datatype] if e not in ("subject", "session")]
        sizes = (0, 1, 2, 3) if combined else (0, 1)
        for suffix in suffixes:
            for chosen in (c for n in sizes for c in combinations(free, n)):
                parts = [datatype, suffix.lower(), *sorted(chosen)]
                key = "_".join(["full", *parts] if combined else parts)
                named = "".join(
                    "_run-{item:02d}" if e == "run" else f"_{e}-{{{e}}}"
                    for e in ENTITY_ORDER
                    if e in chosen
                )
                pattern = (
                    f"sub-{{subject}}/{{session}}/{datatype}/sub-{{subject}}_{{session}}"
                    f"{named}_{suffix}"
                )
                rows.append((datatype, suffix, "_".join(sorted(chosen)), key, pattern))
    return rows


def _coverage(combined: bool) -> str:
    patterns = _values(
        _pattern_rows(combined), "datatype, suffix, entity_key, pattern_key, pattern"
    )
    observed = """
SELECT datatype, suffix, entity_key, count(*) AS n FROM (
  SELECT datatype, suffix, COALESCE((SELECT string_agg(name, '_' ORDER BY name) FROM (
      SELECT DISTINCT COALESCE(s.entity, u.k) AS name
      FROM (SELECT string_split(unnest(entity_parts), '-')[1] AS k) u
      LEFT JOIN short_names s ON s.short_name = u.k)
    WHERE name NOT IN ('subject', 'session')), '') AS entity_key
  FROM parsed) GROUP BY ALL"""
    return _with(
        ["parsed", "short_names"],
        """SELECT COALESCE(o.datatype, p.datatype) AS datatype,
  COALESCE(o.suffix, p.suffix) AS suffix, COALESCE(o.entity_key, p.entity_key) AS entity_key,
  pattern_key, pattern, CAST(COALESCE(n, 0) AS BIGINT) AS n_paths,
  CASE WHEN pattern_key IS NULL THEN 'uncovered' WHEN n IS NULL THEN 'unused' ELSE 'covered' END
    AS coverage
FROM observed o FULL JOIN patterns p ON o.datatype = p.datatype AND o.suffix = p.suffix
  AND o.entity_key = p.entity_key""",
        {"observed": observed, "patterns": patterns},
    )


# --- mapping --------------------------------------------------------------------------------------

_MAPPING = (
    "bids_modality, bids_suffix, bids_entities, bids_confidence, bids_path, mapping_source, "
    "suffix_valid"
)

# Expected reading of the damaged answers, from position and batch alone.
_ANSWERED = """
SELECT n.*, b.size, CASE WHEN batch_id % 7 = 4 THEN false
    WHEN batch_id % 7 = 5 THEN pos < b.size - 1
    WHEN batch_id % 7 = 6 THEN pos % 2 = 0 ELSE true END AS usable, pos % 5 AS kind
FROM mapped n JOIN (SELECT batch_id, count(*) AS size FROM numbered GROUP BY 1) b USING (batch_id)
"""


# The texts and names below are written out here once more, so that the oracle does not agree
# with the implementation by sharing it.
_PROMPT = """VOCABULARY
{"version":"seed","datatypes":{"anat":["FLAIR","T1w","T2w"],"func":["bold"],\
"fmap":["fieldmap","magnitude","phasediff"],"dwi":["dwi"],"perf":["asl"]},\
"entities":["sub","ses","task","acq","run","echo","dir","rec","space","desc"]}

TASK
Choose one datatype and one of its suffixes for every acquisition listed below. Add an entity only \
where the attributes name its value. State how sure you are as a number from 0 to 1.

PATHS
<datatype>/sub-{subject}_ses-{session}_<entity-value, in vocabulary order>_<suffix>

ACQUISITIONS
["""
_REPLY = """]

REPLY
One JSON list of the same length and order. Fields of an element: bids_modality, bids_suffix, \
bids_entities (object), bids_confidence (number), bids_path. No other text."""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RECORD = (
    "'{' || "
    + " || ',' || ".join(_json_field(k) for k in (*KEYS.split(", "), "series_count"))
    + " || '}'"
)

_PROGRAM_BODY = (
    "'from heudiconv.utils import SeqInfo\n' || CASE WHEN batch_id % 4 = 3 THEN '' "
    "ELSE 'def create_key(t):\n    return t\n' END || 'def infotodict(seqinfo):\n    # ' || "
    "string_agg(group_id, ' ' ORDER BY pos) || '\n    return {}'"
)

# --- rules ----------------------------------------------------------------------------------------

_PLAIN_RULES = "SELECT *, bids_path AS path, '' AS variant, 0 AS variant_no FROM mapped"
_VARIANT_RULES = """
SELECT *, bids_path AS path, '' AS variant, 0 AS variant_no
  FROM mapped WHERE NOT contains(bids_path, '_T2w')
UNION ALL BY NAME
SELECT *, replace(bids_path, '_T2w', '_rec-norm_T2w') AS path, 'norm' AS variant, 0 AS variant_no
  FROM mapped WHERE contains(bids_path, '_T2w')
UNION ALL BY NAME
SELECT *, bids_path AS path, 'non_norm' AS variant, 1 AS variant_no
  FROM mapped WHERE contains(bids_path, '_T2w')"""
_KEY = "'key_' || group_no || CASE WHEN variant = '' THEN '' ELSE '_' || variant END"
_DESCRIPTION = """series_description
  || CASE WHEN protocol_name <> series_description THEN ' (' || protocol_name || ')' ELSE '' END
  || CASE WHEN TR > 0 THEN ' TR=' || TR || 'ms' ELSE '' END
  || CASE WHEN TE > 0 THEN ' TE=' || TE || 'ms' ELSE '' END
  || CASE WHEN series_count > 1 THEN ' n=' || series_count ELSE '' END"""
_CONDITION = """'"' || lower(protocol_name) || '" in s.protocol_name.lower() and "'
  || lower(series_description) || '" in s.series_description.lower() and "'
  || lower(sequence_name) || '" in s.sequence_name.lower()'
  || CASE WHEN TR > 0 THEN ' and abs(s.TR - ' || TR || ') < 50' ELSE '' END
  || CASE WHEN TE > 0 THEN ' and abs(s.TE - ' || TE || ') < 5' ELSE '' END"""
_FILTER = """CASE variant WHEN 'norm' THEN '"NORM" in str(s.image_type)'
  WHEN 'non_norm' THEN '"NORM" not in str(s.image_type)'
  ELSE '"' || image_type || '" in image_type' END"""
_THETA = """contains(lower(COALESCE(s.protocol_name, '')), lower(r.protocol_name))
  AND contains(lower(COALESCE(s.series_description, '')), lower(r.series_description))
  AND contains(lower(COALESCE(s.sequence_name, '')), lower(r.sequence_name))
  AND (r.TR <= 0 OR abs(s.TR - r.TR) < 50) AND (r.TE <= 0 OR abs(s.TE - r.TE) < 5)"""
_IMAGE_FILTER = """CASE r.variant WHEN 'norm' THEN contains(s.image_type, 'NORM')
  WHEN 'non_norm' THEN NOT contains(s.image_type, 'NORM')
  ELSE contains(s.image_type, r.image_type) END"""


_IMAGE_COLUMNS = (["image_type"], ["variant", "image_type"])
_SERIES_TEXTS = ["protocol_name", "series_description", "sequence_name"]


def _distinct_theta(condition: str, of_series: list[str], of_rule: list[str]) -> dict[str, str]:
    """The theta join over distinct attributes of series (``d``) and of rules (``q``), as ``m``.

    Joined back by equality it gives the rows of the join of all series with all rules.
    """
    series = ", ".join([*_SERIES_TEXTS, "TR", "TE", *of_series])
    rule = ", ".join([*_SERIES_TEXTS, "TR", "TE", *of_rule])
    d = ", ".join(f"s.{c} AS s_{c}" for c in series.split(", "))
    q = ", ".join(f"r.{c} AS r_{c}" for c in rule.split(", "))
    return {
        "d": f"SELECT {series}, count(*) AS n FROM series GROUP BY ALL",
        "q": f"SELECT DISTINCT {rule} FROM r",
        "m": f"SELECT {d}, {q}, s.n FROM q r JOIN d s ON {condition}",
    }


def _same_as(alias: str, columns: list[str]) -> str:
    return " AND ".join(
        f"m.{alias}_{c} IS NOT DISTINCT FROM {alias}.{c}"
        for c in [*_SERIES_TEXTS, "TR", "TE", *columns]
    )


def _matches(rule_sql: str, condition: str, of_series: list[str], of_rule: list[str]) -> str:
    return _with(
        ["mapped", "series"],
        f"""SELECT {_KEY} AS key_name, s.series_id FROM m JOIN r ON {_same_as("r", of_rule)}
JOIN series s ON {_same_as("s", of_series)}""",
        {"r": rule_sql, **_distinct_theta(condition, of_series, of_rule)},
    )


_PROGRAM_HEADER = [
    "from heudiconv.utils import SeqInfo",
    "",
    "",
    'def create_key(template, outtype=("nii.gz",), annotation_classes=None):',
    "    if not template:",
    '        raise ValueError("a key needs a template")',
    "    return template, outtype, annotation_classes",
    "",
    "",
    "def infotodict(seqinfo: list[SeqInfo]):",
    "    # Context: T2w scans: use _rec-norm_ for NORM, judged by image_type",
]
_PROGRAM_LOOP = [
    "    }",
    "    for s in seqinfo:",
    "        image_type = str(s.image_type).replace(\"'\", \"\")"
    ".replace(\"[\", \"\").replace(\"]\", \"\")",
    "        pass",
]


def _fixed_lines(section: int, lines: list[str]) -> str:
    rows = [(section, i, line) for i, line in enumerate(lines)]
    return (
        "SELECT 'study' AS study, section, 0::BIGINT AS group_no, 0 AS variant_no, line_no, line "
        f"FROM ({_values(rows, 'section, line_no, line')})"
    )


def _rule_lines(section: int, line_no: int, line: str) -> str:
    return (
        f"SELECT study, {section} AS section, group_no, variant_no, {line_no} AS line_no, "
        f"{line} AS line FROM r"
    )


def _program() -> str:
    lines = [
        _fixed_lines(0, _PROGRAM_HEADER),
        _rule_lines(
            1, 0, f"""'    ' || {_KEY} || ' = create_key("' || path || '")  # ' || {_DESCRIPTION}"""
        ),
        _fixed_lines(2, ["    info = {"]),
        _rule_lines(3, 0, f"'        ' || {_KEY} || ': [],'"),
        _fixed_lines(4, _PROGRAM_LOOP),
        _rule_lines(5, 0, f"'        if ' || {_CONDITION} || ' and ' || {_FILTER} || ':'"),
        _rule_lines(5, 1, f"'            info[' || {_KEY} || '].append(s.series_id)'"),
        _fixed_lines(6, ["    return info"]),
    ]
    return _with(["mapped"], " UNION ALL ".join(lines), {"r": _VARIANT_RULES})


_RULE_BLOCK = '''\'{"target":"\' || bids_path || \'","protocol_name":"\' || protocol_name
  || \'","series_description":"\' || series_description || \'","sequence_name":"\' || sequence_name
  || \'","size":"\' || dim1 || 'x' || dim2 || 'x' || dim3 || 'x' || dim4 || \'","TR":"\' || TR
  || \'","TE":"\' || TE || \'","is_derived":"\' || is_derived || \'","is_motion_corrected":"\'
  || is_motion_corrected || \'","image_type":"\' || image_type || \'","series_count":"\'
  || series_count || \'","total_files":"\' || total_files || \'","series_id":"\'
  || representative_series_id || \'","example_dcm_file":"\' || example_dcm_file || \'"}\''''


_UNITED = """
SELECT * EXCLUDE (row_ord, image_type), NULL AS image_type FROM series
UNION BY NAME SELECT * EXCLUDE (row_ord, sequence_name), NULL AS sequence_name FROM series"""

_FINGERPRINT = """
SELECT directory, count(*) AS n_files, md5(concat_ws(':', directory, count(*),
  CAST(sum(length) AS BIGINT), CAST(sum(('0x' || d[1:15])::BIGINT) AS VARCHAR),
  CAST(sum(('0x' || d[16:30])::BIGINT) AS VARCHAR))) AS fingerprint
FROM (SELECT *, md5(concat_ws(':', string_split(path, '/')[-1], length,
    epoch_ms(modificationTime))) AS d, array_to_string(string_split(path, '/')[:-2], '/')
    AS directory FROM paths {where}) GROUP BY directory"""


def sql() -> dict[str, str]:
    known_short = list(ENTITY_SHORT.values())
    return {
        "consolidated": _with(
            ["series"],
            """SELECT *, subject AS subject_id, COALESCE(NULLIF(session, ''), 'single_session')
  AS session_id FROM united""",
            {"united": _UNITED},
        ),
        "scanned_tables": _with(
            ["series"],
            """SELECT CAST(series_id AS VARCHAR) AS series_id, subject, session, protocol_name,
  series_description, sequence_name, dim1, dim2, dim3, dim4, TR, TE, is_derived,
  is_motion_corrected, image_type, series_files, example_dcm_file, dcm_dir_name FROM united""",
            {"united": _UNITED},
        ),
        "written_texts": """SELECT concat_ws('-', conv_id, turn) AS series_id,
  '"' || role || '"' || chr(9) || '"tab" and \\' || chr(10) || '"' || text || '"' AS note
FROM conversations""",
        "split_table_scan": """SELECT concat_ws('-', conv_id, turn) AS series_id,
  text || chr(10) || chr(9) || chr(10) || role AS note, '5" ' || role AS protocol_name
FROM conversations""",
        "ingested_groups": _with(
            ["ingested"],
            f"""SELECT {_GROUP_ID} AS group_id, series_count, representative_series_id, total_files,
  subject, session, example_dcm_file, dcm_dir_name FROM (SELECT study, {KEYS},
  count(*) AS series_count, CAST(sum(series_files) AS BIGINT) AS total_files,
  CAST(arg_min(series_id, o) AS VARCHAR) AS representative_series_id, arg_min(subject, o) AS subject,
  arg_min(session, o) AS session, arg_min(example_dcm_file, o) AS example_dcm_file,
  arg_min(dcm_dir_name, o) AS dcm_dir_name FROM ingested GROUP BY ALL)""",
        ),
        "answer_store": """
SELECT conv_id, turn, CASE WHEN length(text) % 10 < 2 THEN 2 WHEN text IS NOT NULL THEN 1 END AS attempts,
  CASE WHEN length(text) % 10 > 1 THEN string_split(text, ' ')[1] || ':' || length(text) END AS answer,
  CASE length(text) % 10 WHEN 0 THEN 'ValueError: refused' WHEN 1 THEN 'no answer' END AS error
FROM conversations""",
        "conversation_programs": """
SELECT conv_id, turn, contains(text, 'from heudiconv.utils import SeqInfo') AS has_imports,
  contains(text, 'def create_key(') AS has_create_key,
  contains(text, 'def infotodict(') AS has_infotodict,
  contains(text, 'from heudiconv.utils import SeqInfo') AND contains(text, 'def create_key(')
    AND contains(text, 'def infotodict(') AS accepted
FROM conversations""",
        "subject_sessions": _with(
            ["paths"],
            """SELECT subject, session FROM (
  SELECT DISTINCT string_split(path, '/')[1][5:] AS subject,
    CASE WHEN starts_with(string_split(path, '/')[2], 'ses-')
      THEN string_split(path, '/')[2][5:] END AS session
  FROM paths WHERE starts_with(path, 'sub-'))
QUALIFY session IS NOT NULL OR count(session) OVER (PARTITION BY subject) = 0""",
        ),
        "numbered_sessions": """SELECT subject, session FROM (
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS subject,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 3 AS VARCHAR) END AS session FROM orders)
QUALIFY session IS NOT NULL OR count(session) OVER (PARTITION BY subject) = 0""",
        "flat_session": "SELECT '01' AS subject, CAST(NULL AS VARCHAR) AS session",
        "fingerprints": _with(["paths"], _FINGERPRINT.format(where="")),
        "changed_inputs": _with(
            ["paths"],
            """SELECT c.*, CASE WHEN s.fingerprint IS NULL THEN 'recompute' ELSE 'reuse' END AS status
FROM current_files c LEFT JOIN stored s ON s.directory = c.directory
  AND s.fingerprint = c.fingerprint""",
            {
                "current_files": _FINGERPRINT.format(where=""),
                "stored": _FINGERPRINT.format(
                    where="WHERE modificationTime < TIMESTAMP '2000-01-01'"
                ),
            },
        ),
        "profile_overview": _with(
            ["series"],
            """SELECT 'study' AS study, count(DISTINCT subject) AS n_subjects,
  count(DISTINCT session) AS n_sessions, count(*) AS n_series FROM series""",
        ),
        "profile_ranges": _with(
            ["series"],
            """SELECT 'study' AS study, count(DISTINCT (dim1, dim2)) AS n_matrix_sizes,
  min(TRY_CAST(dim3 AS DOUBLE)) AS dim3_min, max(TRY_CAST(dim3 AS DOUBLE)) AS dim3_max,
  min(TRY_CAST(dim4 AS DOUBLE)) AS dim4_min, max(TRY_CAST(dim4 AS DOUBLE)) AS dim4_max,
  round(min(TR), 1) AS TR_min, round(max(TR), 1) AS TR_max,
  round(min(TE), 1) AS TE_min, round(max(TE), 1) AS TE_max FROM series""",
        ),
        "profile_moco": _with(
            ["series"],
            """SELECT 'study' AS study, count(*) FILTER (WHERE NOT is_motion_corrected) AS n_original,
  count(*) FILTER (WHERE is_motion_corrected) AS n_motion_corrected FROM series""",
        ),
        "profile_protocols": _with(
            ["series"],
            """SELECT 'study' AS study, CAST(row_number() OVER (ORDER BY n_series DESC, o) AS INTEGER)
  AS rank, protocol_name, n_series, CAST(count(*) OVER () AS BIGINT) AS n_protocols,
  CAST(greatest(count(*) OVER () - 10, 0) AS BIGINT) AS n_more
FROM (SELECT protocol_name, count(*) AS n_series, min(row_ord) AS o FROM series
  WHERE protocol_name IS NOT NULL GROUP BY 1) ORDER BY 2 LIMIT 10""",
        ),
        "series_total": _with(
            ["series"],
            "SELECT 'study' AS study, count(DISTINCT series_id) AS n_series FROM series",
        ),
        "series_coerced": _with(
            ["coerced"],
            """SELECT series_id, dim1, dim2, dim3, dim4, TR, TE, is_derived, is_motion_corrected
FROM coerced""",
        ),
        "series_groups": _with(["groups"], "SELECT * FROM groups"),
        "series_groups_null_keys": _with(["coerced"], _grouped("coerced")),
        "numbered_groups": _with(
            ["numbered"], "SELECT study, group_no, group_id, series_count FROM numbered"
        ),
        "refreshed_groups": _with(["groups"], "SELECT * FROM groups"),
        "group_totals": _with(
            ["groups"],
            """SELECT study, count(*) AS n_groups, CAST(sum(series_count) AS BIGINT) AS n_series
FROM groups GROUP BY 1""",
        ),
        "top_groups": _with(
            ["numbered"],
            """SELECT study, CAST(group_no AS INTEGER) AS rank, series_count,
  protocol_name AS protocol, series_description AS description,
  dim1 || 'x' || dim2 || 'x' || dim3 AS dimensions,
  CAST(greatest((SELECT count(*) FROM groups) - 10, 0) AS BIGINT) AS n_more
FROM numbered WHERE group_no <= 10""",
        ),
        "classify_series": _with(
            ["classified"],
            """SELECT series_id, modality, suffix, concat_ws(',',
  'direction=' || direction, 'task=' || task) AS entities, round(confidence, 4) AS confidence
FROM classified""",
        ),
        "path_templates": _with(
            ["classified"],
            """SELECT series_id, 'sub-{subject}/{session}/' || modality || '/sub-{subject}_{session}'
  || COALESCE('_task-' || task, '') || COALESCE('_direction-' || direction, '') || '_' || suffix
  AS session_template, 'sub-{subject}/' || modality || '/sub-{subject}'
  || COALESCE('_task-' || task, '') || COALESCE('_direction-' || direction, '') || '_' || suffix
  AS path_template FROM classified""",
        ),
        "validate_paths": _validate(MRI_DATATYPES, known_short),
        "validate_paths_strict": _validate(["mri"], ENTITY_ORDER),
        "suffix_conformance": _with(
            ["parsed", "suffixes"],
            """SELECT path_id, p.datatype, p.suffix, s.pos IS NOT NULL AS suffix_valid
FROM parsed p LEFT JOIN suffixes s ON s.datatype = p.datatype AND s.suffix = p.suffix""",
        ),
        "entity_conformance": _with(
            ["parsed", "entities"],
            """SELECT path_id, datatype, short_name
FROM (SELECT path_id, datatype, string_split(unnest(entity_parts), '-')[1] AS short_name FROM parsed) u
WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.datatype = u.datatype
  AND e.short_name = u.short_name)""",
        ),
        "entity_order_check": _with(
            ["parsed", "short_names"],
            """SELECT path_id, COALESCE(bool_and(p >= before OR before IS NULL), true) AS in_order
FROM (SELECT u.path_id, s.pos AS p, lag(s.pos) OVER (PARTITION BY u.path_id ORDER BY i) AS before
  FROM (SELECT path_id, unnest(entity_parts) AS part,
      unnest(range(len(entity_parts))) AS i FROM parsed) u
  LEFT JOIN short_names s ON s.short_name = string_split(u.part, '-')[1]
  WHERE s.pos IS NOT NULL) GROUP BY 1""",
        ),
        "combination_check": _with(
            ["parsed", "suffixes", "entities"],
            """SELECT path_id, CASE WHEN s.pos IS NULL THEN 'unknown suffix'
  WHEN list_has_all(e.allowed, list_transform(entity_parts, lambda x: string_split(x, '-')[1]))
  THEN 'legal' ELSE 'illegal' END AS combination
FROM parsed p LEFT JOIN suffixes s ON s.datatype = p.datatype AND s.suffix = p.suffix
LEFT JOIN (SELECT datatype, list(short_name) AS allowed FROM entities GROUP BY 1) e
  ON e.datatype = p.datatype""",
        ),
        "versioned_conformance": _with(
            ["asking", "rule_sets", "rule_entities"],
            """SELECT path_id, version, CASE WHEN version IS NOT NULL THEN known END AS suffix_valid,
  CASE WHEN version IS NOT NULL THEN array_to_string(list_filter(keys, lambda k: NOT list_contains(
    COALESCE(names, []), k)), ',') END AS illegal_entities,
  CASE WHEN version IS NULL THEN NULL WHEN NOT known THEN 'unknown suffix' WHEN fits THEN 'legal'
    ELSE 'illegal' END AS combination
FROM (SELECT a.*, EXISTS (SELECT 1 FROM rule_sets s WHERE s.version = a.version
      AND s.datatype = a.datatype AND s.suffix = a.suffix) AS known,
    EXISTS (SELECT 1 FROM rule_sets s WHERE s.version = a.version AND s.datatype = a.datatype
      AND s.suffix = a.suffix AND list_has_all(s.allowed, a.keys)) AS fits FROM asking a) a
LEFT JOIN (SELECT version AS v, datatype AS d, list(name) AS names FROM rule_entities GROUP BY ALL) e
  ON e.v = a.version AND e.d = a.datatype""",
        ),
        "catalog_dimensions": _with(
            ["rule_sets", "rule_entities"],
            """SELECT DISTINCT version, datatype, 'suffix' AS kind, suffix AS name FROM rule_sets
UNION SELECT version, 'mri', 'suffix', suffix FROM rule_sets
UNION ALL SELECT version, datatype, 'entity', name FROM rule_entities""",
        ),
        "pattern_coverage": _coverage(combined=False),
        "pattern_coverage_combined": _coverage(combined=True),
        "fallback_mapping": _with(["mapped"], f"SELECT group_id, {_MAPPING} FROM mapped"),
        # A model without answers: the same as the keyword rules alone.
        "model_mapping": _with(["mapped"], f"SELECT group_id, {_MAPPING} FROM mapped"),
        "mapping_metrics": _with(
            ["mapped"],
            """SELECT count(*) AS n_groups, count(*) FILTER (WHERE bids_path <> 'unmapped') AS n_mapped,
  round(100e0 * count(*) FILTER (WHERE bids_path <> 'unmapped') / count(*), 1) AS mapped_percent
FROM mapped""",
        ),
        "mapping_by_modality": _with(
            ["mapped"], "SELECT bids_modality, count(*) AS n_groups FROM mapped GROUP BY 1"
        ),
        "top_mappings": _with(
            ["mapped"],
            """SELECT series_count, protocol_name AS protocol, bids_path AS path,
  bids_confidence, group_id FROM mapped WHERE bids_path <> 'unmapped'
ORDER BY series_count DESC, group_id LIMIT 5""",
        ),
        "prompt_batches": _with(
            ["numbered"],
            f"""SELECT study, batch_id, 0 AS part, 0 AS first_pos, CAST(count(*) AS INTEGER) AS n_groups,
  {_quoted(_PROMPT)} || string_agg({_RECORD}, ',\n' ORDER BY pos) || {_quoted(_REPLY)} AS prompt
FROM numbered GROUP BY study, batch_id""",
        ),
        "sequence_prompts": _with(
            ["numbered"],
            """SELECT study, batch_id, 'Propose a file name for each numbered scan.\n'
  || string_agg('#' || (pos + 1) || ' protocol=' || protocol_name || ' | description='
    || series_description, '\n' ORDER BY pos)
  || '\nReply with a line per scan: its number, a full stop, the name, '' - '', the reason.' AS prompt
FROM numbered GROUP BY study, batch_id""",
        ),
        "response_recovery": _with(
            ["mapped"],
            """SELECT batch_id, pos,
  ['anat', 'func', 'eeg', 'dwi', 'perf'][kind + 1] AS bids_modality,
  ['T1w', 'bold', 'eeg', 'dwi', NULL][kind + 1] AS bids_suffix,
  ['acq=' || protocol_name, 'run=1,task=rest', '', NULL, NULL][kind + 1] AS bids_entities,
  ['0.95', '0.8', '0.9', '0.7', NULL][kind + 1] AS bids_confidence,
  ['anat/sub-{subject}_ses-{session}_acq-' || protocol_name || '_T1w', 'unmapped', 'eeg/x', '',
    NULL][kind + 1] AS bids_path
FROM answered WHERE usable""",
            {"answered": _ANSWERED},
        ),
        "mapping_attached": _with(
            ["mapped"],
            """SELECT group_id, batch_id, pos,
  CASE WHEN usable THEN ['anat', 'func', 'unknown', 'dwi', 'perf'][kind + 1]
    ELSE bids_modality END AS bids_modality,
  CASE WHEN usable THEN ['T1w', 'bold', 'eeg', 'dwi', 'unknown'][kind + 1]
    ELSE bids_suffix END AS bids_suffix,
  CASE WHEN usable THEN ['acq=' || protocol_name, 'run=1,task=rest', '', '', ''][kind + 1]
    ELSE bids_entities END AS bids_entities,
  CASE WHEN usable THEN [0.95e0, 0.8e0, 0.45e0, 0.7e0, 0.5e0][kind + 1]
    ELSE bids_confidence END AS bids_confidence,
  CASE WHEN usable THEN ['anat/sub-{subject}_ses-{session}_acq-' || protocol_name || '_T1w',
    'func/sub-{subject}_ses-{session}_task-rest_run-1_bold', 'eeg/x',
    'dwi/sub-{subject}_ses-{session}_dwi', 'unmapped'][kind + 1] ELSE bids_path END AS bids_path,
  CASE WHEN usable THEN 'model' ELSE 'fallback' END AS mapping_source,
  CASE WHEN usable THEN [true, true, false, true, false][kind + 1] ELSE suffix_valid END
    AS suffix_valid
FROM answered""",
            {"answered": _ANSWERED},
        ),
        "numbered_responses": _with(
            ["numbered"],
            """SELECT study, batch_id, 'sequence_' || (pos + 1) AS key,
  CASE WHEN pos % 2 = 0 THEN 'sub-{subject}_' || protocol_name ELSE series_description END
  AS pattern FROM numbered WHERE pos > 0 AND pos % 4 <> 3
UNION ALL SELECT DISTINCT study, batch_id, 'sequence_1', 'again_' || batch_id FROM numbered""",
        ),
        "code_responses": _with(
            ["numbered"],
            f"""SELECT study, batch_id, {_PROGRAM_BODY} AS code, true AS has_imports,
  batch_id % 4 <> 3 AS has_create_key, true AS has_infotodict, batch_id % 4 <> 3 AS accepted
FROM numbered GROUP BY study, batch_id""",
        ),
        "rule_table": _with(
            ["mapped"],
            f"""SELECT {_KEY} AS key_name, path AS bids_path, variant, protocol_name,
  series_description, sequence_name, TR, TE, is_derived, is_motion_corrected, image_type,
  series_count, total_files, CAST(representative_series_id AS VARCHAR) AS representative_series_id,
  {_DESCRIPTION} AS description FROM r""",
            {"r": _VARIANT_RULES},
        ),
        "rule_conditions": _with(
            ["mapped"],
            f"""SELECT {_KEY} AS key_name, 3 + (TR > 0)::INTEGER + (TE > 0)::INTEGER AS n_conditions,
  {_CONDITION} AS condition, {_FILTER} AS filter FROM r""",
            {"r": _VARIANT_RULES},
        ),
        "rule_matches": _matches(_PLAIN_RULES, _THETA, [], []),
        "rule_matches_derived": _matches(
            _PLAIN_RULES,
            f"{_THETA} AND COALESCE(s.is_derived, false) = r.is_derived",
            ["is_derived"],
            ["is_derived"],
        ),
        "rule_matches_motion": _matches(
            _PLAIN_RULES,
            f"{_THETA} AND COALESCE(s.is_motion_corrected, false) = r.is_motion_corrected",
            ["is_motion_corrected"],
            ["is_motion_corrected"],
        ),
        "rule_matches_context": _matches(
            _VARIANT_RULES, f"{_THETA} AND {_IMAGE_FILTER}", *_IMAGE_COLUMNS
        ),
        "rule_match_counts": _with(
            ["mapped", "series"],
            f"""SELECT {_KEY} AS key_name, r.path AS bids_path,
  CAST(COALESCE(sum(m.n), 0) AS BIGINT) AS n_series
FROM r LEFT JOIN m ON {_same_as("r", _IMAGE_COLUMNS[1])} GROUP BY ALL""",
            {"r": _VARIANT_RULES, **_distinct_theta(f"{_THETA} AND {_IMAGE_FILTER}", *_IMAGE_COLUMNS)},
        ),
        "rule_program": _program(),
        "rule_posting_lists": _with(
            ["mapped", "series"],
            f"""SELECT key_name, row_number() OVER (PARTITION BY key_name ORDER BY row_ord) AS position,
  CAST(series_id AS VARCHAR) AS series_id FROM found
UNION ALL SELECT {_KEY}, 0, '' FROM r WHERE {_KEY} NOT IN (SELECT key_name FROM found)""",
            {
                "r": _VARIANT_RULES,
                **_distinct_theta(f"{_THETA} AND {_IMAGE_FILTER}", *_IMAGE_COLUMNS),
                "found": f"""SELECT {_KEY} AS key_name, s.series_id, s.row_ord
FROM m JOIN r ON {_same_as("r", _IMAGE_COLUMNS[1])} JOIN series s ON {_same_as("s", _IMAGE_COLUMNS[0])}""",
            },
        ),
        "program_matches": _matches(
            _VARIANT_RULES, f"{_THETA} AND {_IMAGE_FILTER}", *_IMAGE_COLUMNS
        ),
        "program_verdicts": _with(
            ["many_studies"],
            """SELECT study, NOT regexp_matches(study, 'Brand#[35]') AS accepted,
  CASE WHEN contains(study, 'Brand#3') THEN 'syntax'
    WHEN contains(study, 'Brand#5') THEN 'test without append' END AS problem,
  count(*) AS n_rules FROM many_studies GROUP BY study""",
        ),
        "catch_all": _with(
            ["series"],
            "SELECT 'study' AS study, 'run{item:03d}' AS key_name, series_id FROM series",
        ),
        "result_sources": _with(["study_sources"], "SELECT study, source FROM study_sources"),
        "catch_all_studies": _with(
            ["study_sources", "series"],
            f"""SELECT {_STUDY} AS study, 'run{{item:03d}}' AS key_name, series_id FROM series
WHERE {_STUDY} IN (SELECT study FROM study_sources WHERE source = 'catch_all')""",
        ),
        "study_groups": _with(
            ["many_studies"],
            """SELECT study, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_series
FROM many_studies GROUP BY study""",
        ),
        "rule_prompts": _with(
            ["mapped"],
            f"""SELECT study, batch_id,
  'TASK\nTurn the targets below into one heuristic program for study study, read from scans: '
  || (SELECT CAST(sum(series_count) AS BIGINT) FROM groups) || ' series in '
  || (SELECT count(*) FROM groups) || ' groups.\n\nTARGETS\n'
  || string_agg({_RULE_BLOCK}, '\n' ORDER BY pos)
  || '\n\nREPLY\nPython code alone, with SeqInfo from heudiconv.utils and the functions create_key '
  || 'and infotodict.' AS prompt
FROM mapped GROUP BY study, batch_id""",
        ),
        "study_summary": _with(
            ["groups"],
            """SELECT study, CAST(sum(series_count) AS BIGINT) AS n_series, count(*) AS n_groups,
  'scans' AS source_directory FROM groups GROUP BY study""",
        ),
    }
