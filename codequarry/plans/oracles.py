"""SQL that works the registered queries out a second time, for DuckDB.

Texts are matched with RE2, which has no look-around: where a rule needs it, the
statement reaches the same result another way. Common steps are named once in
``STEPS`` and pulled in where a statement mentions them.
"""

from __future__ import annotations

import re

from codequarry import catalog as C
from codequarry import fixtures as FX
from codequarry.functions.text import py_round_sql


def _str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re2(pattern: str, flags: str = "") -> str:
    """A catalogue pattern as an RE2 literal: literal braces escaped."""
    pattern = re.sub(r"(?<!\\)\{(?!\d)", r"\\{", pattern.removeprefix("(?u)"))
    return _str((f"(?{flags})" if flags else "") + pattern)


def _lines_before(text: str) -> str:
    return f"(len({text}) - len(replace({text}, chr(10), '')))"


def _first_line(needle: str) -> str:
    return (f"CASE WHEN contains(content, {needle}) THEN 1 + "
            + _lines_before(f"substr(content, 1, strpos(content, {needle}) - 1)") + " ELSE 0 END")


def _found(kind: str, order: int, source: str, pattern: str, group: int, needle: str,
           flags: str = "m", extra: str = "NULL", extra2: str = "NULL", name: str = "n") -> str:
    """Matches of a pattern in file order, with the line of the first ``needle``."""
    lists = ", ".join(f"regexp_extract_all(content, {_re2(pattern, flags)}, {g}) AS l{g}"
                      for g in range(0, 4) if f"(" in pattern and g <= _groups(pattern))
    picks = ", ".join(f"unnest(l{g}) AS g{g}" for g in range(0, _groups(pattern) + 1))
    return f"""SELECT project, path, {order} AS k, pos, '{kind}' AS type, {name} AS name,
      {_first_line(needle)} AS line, {extra} AS extends, {extra2} AS implements
    FROM (SELECT project, path, content, pos, {f'g{group}'} AS n, * EXCLUDE (project, path, content, pos)
          FROM (SELECT project, path, content, {picks}, generate_subscripts(l{group}, 1) AS pos
                FROM (SELECT project, path, content, {lists} FROM meta WHERE {source}) a) b) c
    WHERE n <> ''"""


def _groups(pattern: str) -> int:
    return re.compile(pattern).groups


_LANGUAGE_ROWS = ", ".join(f"({_str(e)}, {_str(n)})" for e, n in C.LANGUAGES.items())
_EXT = r"regexp_extract(lower(path), '[^/.][^/]*(\.[^/.]*)$', 1)"
_GENERIC = "rules = 'generic' OR broken"
_JS = "rules = 'javascript'"
_JAVA = "rules = 'java'"


def _rule_rows(kind: str, number: int, name: str, pattern: str, message: str, severity: str,
               flags: str) -> str:
    marked = f"regexp_replace(content, '(' || {_re2(pattern, flags)} || ')', chr(1) || '\\1', 'g')"
    return f"""SELECT project, path, '{kind}' AS kind, {number} AS rule, '{name}' AS type,
      {_str(message)} AS message, line, '{severity}' AS severity, unnest(range(n)) AS nth
    FROM (SELECT project, path, line, len(text) - len(replace(text, chr(1), '')) AS n
          FROM (SELECT project, path, unnest(string_split({marked}, chr(10))) AS text,
                  generate_subscripts(string_split({marked}, chr(10)), 1) AS line FROM meta) a) b
    WHERE n > 0"""


_MARKED_NUMBERS = r"regexp_replace(content, '\b(\d{4,})\b', chr(1) || '\1' || chr(2), 'g')"
_STOP = ", ".join(_str(w) for w in C.STOPWORDS)
_RATIO = py_round_sql("comment_count / line_count::DOUBLE", 2)

STEPS: dict[str, str] = {
    "code": FX.CODE_FILES,
    "files": FX.FILES,
    "languages": f"SELECT * FROM (VALUES {_LANGUAGE_ROWS}) t(ext, language)",
    "meta": f"""SELECT f.project, f.path, f.content, coalesce(l.language, 'Unknown') AS language,
      CASE WHEN language = 'Python' THEN 'python'
           WHEN language IN ('JavaScript', 'TypeScript') THEN 'javascript'
           WHEN language = 'Java' THEN 'java' ELSE 'generic' END AS rules,
      (language = 'Python' AND contains(content, 'def broken(:')) AS broken
    FROM (SELECT *, {_EXT} AS ext FROM files) f LEFT JOIN languages l USING (ext)""",

    # every pattern language
    "gen_imports": _found("import", 1, _GENERIC, C.GENERIC_IMPORT, 1, "n"),
    "gen_classes": _found("class", 2, _GENERIC, C.GENERIC_CLASS, 2, "g1 || ' ' || g2"),
    "gen_functions": _found("function", 3, _GENERIC, C.GENERIC_FUNCTION, 2, "g1 || ' ' || g2"),
    "gen_variables": "SELECT * FROM (" + _found(
        "variable", 4, _GENERIC, C.GENERIC_VARIABLE, 1, "n || ' ='") + ") v WHERE line > 0",
    "js_imports": " UNION ALL ".join(
        _found("import", 1, _JS, p, 1, "n").replace(", pos, 'import'", f", {i} * 1000 + pos AS pos, 'import'", 1)
        for i, p in enumerate(C.JS_IMPORTS)),
    "js_classes": _found("class", 2, _JS, C.JS_CLASS, 1, "'class ' || n", extra="nullif(g2, '')"),
    "js_functions": " UNION ALL ".join(
        _found("function", 3, _JS, p, 1, "n").replace(", pos, 'function'", f", {i} * 1000 + pos AS pos, 'function'", 1)
        for i, p in enumerate(C.JS_FUNCTIONS)),
    "js_components": f"""SELECT * FROM ({_found("component", 4, _JS, C.JS_COMPONENT, 1, "n")}) c
      WHERE NOT EXISTS (SELECT 1 FROM js_classes x WHERE x.project = c.project AND x.path = c.path AND x.name = c.name)
        AND NOT EXISTS (SELECT 1 FROM js_functions x WHERE x.project = c.project AND x.path = c.path AND x.name = c.name)""",
    "java_packages": "SELECT * FROM (" + _found(
        "package", 1, _JAVA, C.JAVA_PACKAGE, 1, "'package ' || n", "") + ") p WHERE pos = 1",
    "java_imports": _found("import", 2, _JAVA, C.JAVA_IMPORT, 1, "'import ' || n", ""),
    "java_classes": _found("class", 3, _JAVA, C.JAVA_CLASS, 1, "'class ' || n", "",
                           extra="nullif(g2, '')", extra2="coalesce(g3, '')"),
    "java_methods": _found("method", 4, _JAVA, C.JAVA_METHOD, 1, "n", ""),

    # Python by lines; text inside triple quotes is blanked first
    "py_text": """SELECT project, path, array_to_string(list_transform(
        string_split(content, '\"\"\"'), lambda x, i: CASE WHEN i % 2 = 0
          THEN regexp_replace(x, '[^\\n]', '', 'g') ELSE x END), '\"\"') AS content
      FROM meta WHERE rules = 'python' AND NOT broken""",
    "py_lines": """SELECT project, path, line, text, len(regexp_extract(text, '^ *')) AS indent
      FROM (SELECT project, path, unnest(string_split(content, chr(10))) AS text,
              generate_subscripts(string_split(content, chr(10)), 1) AS line FROM py_text) a
      WHERE regexp_matches(text, '^\\s*[^\\s#]')""",
    "py_headers": """SELECT h.project, h.path, h.line, any_value(h.text) AS text,
        coalesce(max_by(regexp_matches(p.text, '^\\s*class\\s'), p.line), false) AS in_class,
        max(p.line) AS owner
      FROM py_lines h LEFT JOIN py_lines p ON p.project = h.project AND p.path = h.path
        AND p.line < h.line AND p.indent < h.indent
      WHERE regexp_matches(h.text, '^\\s*(class|def)\\s') GROUP BY ALL""",
    "py_plain_imports": """SELECT project, path, line, unnest(names) AS name, generate_subscripts(names, 1) AS pos
      FROM (SELECT project, path, line, list_transform(string_split(
              regexp_extract(text, '^\\s*import\\s+([^#]*)', 1), ','), lambda x:
                trim(regexp_replace(x, '\\s+as\\s+\\w+', ''))) AS names
            FROM py_lines WHERE regexp_matches(text, '^\\s*import\\s')) a""",
    "py_from_imports": """SELECT project, path, line, pos, 'from ' || module || ' import ' || name AS name
      FROM (SELECT project, path, 1 + len(before) - len(replace(before, chr(10), '')) AS line, module,
              generate_subscripts(string_split(names, ','), 1) AS pos,
              regexp_replace(regexp_replace(unnest(string_split(replace(replace(names, '(', ''), ')', ''), ',')),
                '\\s+as\\s+\\w+', ''), '\\s+', '', 'g') AS name
            FROM (SELECT project, path, array_to_string(pieces[1:i], '') AS before,
                    regexp_extract(pieces[i + 1], '^from\\s+\\.*\\s*([\\w.]*)\\s+import', 1) AS module,
                    regexp_extract(pieces[i + 1], '^from[^\\n]*?import\\s*(\\([^)]*\\)|[^\\n(#]+)', 1) AS names
                  FROM (SELECT project, path, pieces, unnest(range(1, len(pieces))) AS i
                        FROM (SELECT project, path, string_split(regexp_replace(content,
                                '(?m)^(from\\s)', chr(1) || '\\1', 'g'), chr(1)) AS pieces
                              FROM py_text) a) b) c) d WHERE name <> ''""",
    "py_classes": """SELECT c.project, c.path, c.line, regexp_extract(c.text, 'class\\s+(\\w+)', 1) AS name,
        coalesce(array_to_string(list_filter(list_transform(string_split(
          regexp_extract(c.text, 'class\\s+\\w+\\(([^)]*)\\)', 1), ','), lambda x: trim(x)),
          lambda x: regexp_matches(x, '^[A-Za-z_]\\w*$')), ','), '') AS bases,
        coalesce(string_agg(regexp_extract(m.text, 'def\\s+(\\w+)', 1), ',' ORDER BY m.line), '') AS methods
      FROM py_headers c LEFT JOIN py_headers m ON m.project = c.project AND m.path = c.path
        AND m.owner = c.line AND regexp_matches(m.text, '^\\s*def\\s')
      WHERE regexp_matches(c.text, '^\\s*class\\s') GROUP BY c.project, c.path, c.line, c.text""",
    "py_defs": """SELECT project, path, line, in_class, name, CASE WHEN star > 0
          THEN params[1:star - 1] ELSE params END AS params
      FROM (SELECT *, coalesce(list_position(list_transform(params, lambda x: x[1] = '*'), true), 0) AS star
            FROM (SELECT project, path, line, in_class, regexp_extract(text, 'def\\s+(\\w+)', 1) AS name,
                    list_filter(list_transform(string_split(regexp_extract(text, 'def\\s+\\w+\\(([^)]*)\\)', 1), ','),
                      lambda x: trim(regexp_replace(x, '=.*', ''))), lambda x: x <> '') AS params
                  FROM py_headers WHERE regexp_matches(text, '^\\s*def\\s')) a) b""",
    "py_variables": """SELECT project, path, line, unnest(names) AS name, generate_subscripts(names, 1) AS pos
      FROM (SELECT project, path, line, list_filter(list_transform(string_split(
              regexp_extract(text, '^((?:\\w+\\s*=\\s*)+)(?:[^=]|$)', 1), '='), lambda x: trim(x)), lambda x: x <> '') AS names
            FROM py_lines WHERE indent = 0) a""",
    "py_elements": """SELECT project, path, 'import' AS type, name, line, NULL AS params, NULL AS bases, NULL AS methods, pos FROM py_plain_imports
      UNION ALL SELECT project, path, 'import', name, line, NULL, NULL, NULL, pos FROM py_from_imports
      UNION ALL SELECT project, path, 'class', name, line, NULL, bases, methods, 0 FROM py_classes
      UNION ALL SELECT project, path, 'function', name, line, array_to_string(params, ','), NULL, NULL, 0 FROM py_defs WHERE NOT in_class
      UNION ALL SELECT project, path, 'variable', name, line, NULL, NULL, NULL, pos FROM py_variables""",

    "rule_elements": " UNION ALL ".join(f"SELECT * FROM {t}" for t in (
        "gen_imports", "gen_classes", "gen_functions", "gen_variables", "js_imports", "js_classes",
        "js_functions", "js_components", "java_packages", "java_imports", "java_classes", "java_methods")),
    "elements": """SELECT project, path, type, name, line, extends, k * 100000 + pos AS found,
        NULL AS params, NULL AS bases, NULL AS methods FROM rule_elements
      UNION ALL SELECT project, path, type, name, line, NULL, line * 1000 + pos +
        CASE type WHEN 'import' THEN 100 WHEN 'class' THEN 200 WHEN 'function' THEN 300 ELSE 400 END,
        params, bases, methods FROM py_elements""",

    # figures per file
    "depths": """SELECT project, path, max(CASE WHEN regexp_matches(text, '^\\s*(#|//|/\\*|\\*)')
          OR trim(text) = '' THEN 0 ELSE len(regexp_extract(text, '^\\s*')) // 4 END) AS depth
      FROM (SELECT project, path, unnest(string_split(content, chr(10))) AS text FROM meta) a GROUP BY ALL""",
    "words": f"""SELECT project, path, lower(word) AS word, pos
      FROM (SELECT project, path, unnest(l) AS word, generate_subscripts(l, 1) AS pos
            FROM (SELECT project, path, regexp_extract_all(regexp_replace(regexp_replace(
                    array_to_string(regexp_extract_all(content, {_re2(C.IDENTIFIER)}), '_'),
                    '[A-Z]([0-9])', ' \\1', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'),
                    '[A-Z]?[a-z]+|[A-Z]+') AS l FROM meta) a) b
      WHERE len(word) > 2 AND lower(word) NOT IN ({_STOP})""",
    "ranked_words": """SELECT project, path, word, count(*) AS cnt, row_number() OVER (
          PARTITION BY project, path ORDER BY count(*) DESC, min(pos)) - 1 AS rnk
        FROM words GROUP BY project, path, word""",
    "concepts": "SELECT * FROM ranked_words WHERE rnk < 10",
    "magic": f"""SELECT project, path, 'smell' AS kind, 3 AS rule, 'magic_number' AS type,
        {_str(C.SMELL_RULES[2][2])} AS message, 1 + len(before) - len(replace(before, chr(10), '')) AS line,
        'medium' AS severity, i AS nth
      FROM (SELECT project, path, i, array_to_string(pieces[1:i], '') AS before, pieces[i + 1] AS piece
            FROM (SELECT project, path, pieces, unnest(range(1, len(pieces))) AS i
                  FROM (SELECT project, path, string_split({_MARKED_NUMBERS}, chr(1)) AS pieces
                        FROM meta) a) b) c
      WHERE NOT regexp_matches(before, '[.-]$')
        AND NOT regexp_matches(split_part(piece, chr(2), 2), '^(\\.|-|\\s*[/*+-])')""",
    "findings": " UNION ALL ".join(
        [_rule_rows("smell", i + 1, n, p, m, "medium", "ms") for i, (n, p, m) in
         enumerate(C.SMELL_RULES[:2])]
        + ["SELECT * FROM magic"]
        + ["""SELECT project, path, 'smell' AS kind, 4, 'too_many_arguments', 'Function ' || name || ' has '
              || len(params) || ' parameters. Consider refactoring.', line, 'medium', 1
            FROM py_defs WHERE len(params) > 5"""]
        + [_rule_rows("security", i + 5, n, p, m, "high", "m") for i, (n, p, m) in
           enumerate(C.SECURITY_RULES)]),
    "type_counts": """SELECT project, path, count(*) AS n_all,
        count(*) FILTER (type = 'import') AS n_import, count(*) FILTER (type = 'class') AS n_class,
        count(*) FILTER (type = 'function') AS n_function, count(*) FILTER (type = 'variable') AS n_variable,
        count(*) FILTER (type = 'method') AS n_method, count(*) FILTER (type = 'component') AS n_component,
        count(*) FILTER (type = 'package') AS n_package FROM elements GROUP BY ALL""",
    "finding_totals": """SELECT project, path, count(*) FILTER (kind = 'smell') AS smells,
        count(*) FILTER (kind = 'security') AS issues FROM findings GROUP BY ALL""",
    "raw_figures": f"""SELECT m.*, CAST(strlen(content) AS BIGINT) AS size,
        {_lines_before('content')} + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END AS line_count,
        CAST(len(regexp_extract_all(content, {_re2(C.COMMENT, 'm')})) AS BIGINT) AS comment_count,
        CAST({' + '.join(f"len(regexp_extract_all(content, {_str(chr(92) + 'b' + w + chr(92) + 'b')}))" for w in C.DECISION_WORDS)} AS BIGINT) AS cyclomatic,
        CAST(d.depth AS BIGINT) AS depth, regexp_matches(content, {_re2(C.SHORT_VARIABLE)}) AS short_names,
        coalesce(t.n_all, 0) AS n_all, coalesce(t.n_import, 0) AS n_import, coalesce(t.n_class, 0) AS n_class,
        coalesce(t.n_function, 0) AS n_function, coalesce(t.n_variable, 0) AS n_variable,
        coalesce(t.n_method, 0) AS n_method, coalesce(t.n_component, 0) AS n_component,
        coalesce(t.n_package, 0) AS n_package, coalesce(f.smells, 0) AS smells, coalesce(f.issues, 0) AS issues
      FROM meta m JOIN depths d USING (project, path) LEFT JOIN type_counts t USING (project, path)
        LEFT JOIN finding_totals f USING (project, path)""",
    "figures": f"""SELECT *, CASE WHEN cyclomatic < 5 THEN 'low' WHEN cyclomatic < 10 THEN 'medium' ELSE 'high' END AS rating,
        greatest(0, least(100, 100 - smells * 5 - issues * 10 - CASE WHEN cyclomatic > 15 THEN 20
          WHEN cyclomatic > 10 THEN 10 WHEN cyclomatic > 5 THEN 5 ELSE 0 END)) AS quality_score,
        {_RATIO} AS comment_ratio FROM raw_figures""",
    "sentences": """SELECT project, path, language, concat_ws(' ',
        CASE WHEN language <> 'Unknown' THEN language || ' file' END,
        CASE WHEN n_all = 0 THEN 'with no significant code elements'
             WHEN n_import + n_class + n_function + n_method + n_component > 0 THEN 'containing ' || concat_ws(', ',
               CASE WHEN n_import > 0 THEN n_import || ' imports' END, CASE WHEN n_class > 0 THEN n_class || ' classes' END,
               CASE WHEN n_function > 0 THEN n_function || ' functions' END, CASE WHEN n_method > 0 THEN n_method || ' methods' END,
               CASE WHEN n_component > 0 THEN n_component || ' components' END) END,
        'with ' || line_count || ' lines',
        CASE WHEN comment_ratio > 0.2 THEN 'well-documented (' || CAST(floor(comment_ratio * 100) AS BIGINT) || '% comments)'
             WHEN comment_ratio > 0 THEN 'with some documentation (' || CAST(floor(comment_ratio * 100) AS BIGINT) || '% comments)' END) AS summary
      FROM figures""",

    # projects
    "projects": FX.PROJECTS,
    "histogram": """SELECT project, language, count(*) AS files, min(path) AS first_path FROM figures GROUP BY ALL""",
    "top_languages": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project
        ORDER BY files DESC, first_path) AS rnk FROM histogram) a WHERE rnk <= 3""",
    "main_text": """SELECT project, string_agg(language || ' (' || files || ')', ', ' ORDER BY rnk) AS main_languages
      FROM top_languages GROUP BY project""",
    "styles": """SELECT project, count(*) FILTER (contains(name, '_')) AS snake,
        count(*) FILTER (NOT contains(name, '_') AND regexp_matches(name, '^[a-z]') AND regexp_matches(name, '[A-Z]')) AS camel,
        count(*) FILTER (NOT contains(name, '_') AND regexp_matches(name, '^[A-Z]')) AS pascal
      FROM elements WHERE type = 'function' GROUP BY project""",
    "tested": """SELECT f.project, bool_or(regexp_matches(lower(f.path), 'test|spec') OR coalesce(e.hit, false)) AS has_tests
      FROM figures f LEFT JOIN (SELECT project, path, bool_or((type = 'import' AND contains(lower(name), 'test'))
          OR (type = 'function' AND regexp_matches(name, '^(test_|should_)'))) AS hit
        FROM elements GROUP BY ALL) e USING (project, path) GROUP BY f.project""",
    "totals": """SELECT project, count(*) AS file_count, CAST(sum(line_count) AS BIGINT) AS total_lines,
        CAST(sum(n_all) AS BIGINT) AS total_elements, CAST(sum(n_class) AS BIGINT) AS class_count,
        CAST(sum(n_function) AS BIGINT) AS function_count, CAST(sum(quality_score) AS BIGINT) AS quality_sum,
        CAST(sum(CAST(round(comment_ratio * 100) AS BIGINT)) AS BIGINT) AS hundredths,
        CAST(sum(cyclomatic) AS BIGINT) AS cyclomatic_sum, CAST(sum(smells) AS BIGINT) AS smell_sum,
        CAST(sum(issues) AS BIGINT) AS issue_sum FROM figures GROUP BY project""",
    "project_text": """SELECT project, 'Project with ' || file_count || ' files (' || total_lines
        || ' lines of code) primarily written in ' || main_languages || '. Contains ' || class_count || ' classes and '
        || function_count || ' functions. ' || CASE WHEN total_elements > 1000 THEN 'This appears to be a large, complex project.'
          WHEN total_elements > 500 THEN 'This is a medium-sized project with moderate complexity.'
          WHEN total_elements > 100 THEN 'This is a small to medium-sized project.'
          ELSE 'This is a small project with relatively simple structure.' END AS text
      FROM totals JOIN main_text USING (project)""",
    "import_texts": """SELECT project, path, name, found FROM elements WHERE type = 'import'""",
    "top_imports": """SELECT project, name, cnt, rnk FROM (SELECT project, name, count(*) AS cnt, row_number() OVER (
          PARTITION BY project ORDER BY count(*) DESC, min(path || '#' || lpad(CAST(found AS VARCHAR), 9, '0'))) AS rnk
        FROM import_texts GROUP BY project, name) a WHERE rnk <= 10""",
    "project_words": """SELECT project, word, CAST(cnt AS BIGINT) AS cnt, rnk FROM (SELECT project, word, sum(cnt) AS cnt,
          row_number() OVER (PARTITION BY project ORDER BY sum(cnt) DESC, min(path || '#' || lpad(CAST(rnk AS VARCHAR), 9, '0'))) AS rnk
        FROM ranked_words GROUP BY project, word) a WHERE rnk <= 10""",
    "kinds": "SELECT project, kind, type, count(*) AS cnt FROM findings GROUP BY ALL",
    "quality": f"""SELECT project, {py_round_sql('quality_sum / file_count::DOUBLE', 1)} AS quality_score,
        {py_round_sql('hundredths / 100.0e0 / file_count', 2)} AS comment_ratio,
        {py_round_sql('cyclomatic_sum / file_count::DOUBLE', 2)} AS complexity,
        hundredths / 100.0e0 / file_count AS ratio, cyclomatic_sum / file_count::DOUBLE AS mean,
        quality_sum / file_count::DOUBLE AS mean_quality,
        (SELECT count(*) FROM kinds k WHERE k.project = t.project AND kind = 'smell') AS code_smells,
        (SELECT count(*) FROM kinds k WHERE k.project = t.project AND kind = 'security') AS security_issues,
        coalesce((SELECT cnt FROM kinds k WHERE k.project = t.project AND type = 'complex_condition'), 0) AS conditions
      FROM totals t""",
    "ratings": """SELECT *, CASE WHEN ratio > 0.15 THEN 'good' WHEN ratio > 0.05 THEN 'fair' ELSE 'poor' END AS documentation_rating,
        CASE WHEN mean < 5 THEN 'good' WHEN mean < 10 THEN 'fair' ELSE 'poor' END AS complexity_rating,
        CASE WHEN quality_score > 80 THEN 'good' WHEN quality_score > 60 THEN 'fair' ELSE 'poor' END AS overall_rating FROM quality""",
    "naming": """SELECT project, coalesce(snake, 0) AS snake, coalesce(camel, 0) AS camel, coalesce(pascal, 0) AS pascal,
        (snake + camel + pascal > 10 AND (snake = 0 OR snake > (snake + camel + pascal) * 0.2)
         AND (camel = 0 OR camel > (snake + camel + pascal) * 0.2)
         AND (pascal = 0 OR pascal > (snake + camel + pascal) * 0.2)) AS inconsistent FROM styles""",
    "dir_files": """SELECT project, path, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '/') AS dir,
        regexp_extract(path, '([^/]*)$', 1) AS file,
        regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM files""",
    "dirs": """SELECT project, dir, count(*) AS file_count, min(path) AS dir_ord FROM dir_files GROUP BY ALL""",
    "big_dirs": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY file_count DESC, dir_ord)
        AS component_rank FROM dirs WHERE file_count >= 2) a WHERE component_rank <= 10""",
    "ai_advice": f"""SELECT project, nth, type, message FROM (
        SELECT project, unnest([security_issues > 0, conditions > 3, mean_quality < 70]) AS holds,
          unnest([0, 1, 2]) AS nth, unnest(['security', 'complexity', 'quality']) AS type,
          unnest([{", ".join(_str(C.AI_RECOMMENDATIONS[k]) for k in ("security", "complexity", "quality"))}]) AS message
        FROM quality) a WHERE holds""",
    "own_advice": f"""SELECT project, nth, type, message FROM (
        SELECT r.project, unnest([documentation_rating = 'poor', complexity_rating = 'poor', coalesce(c.n, 0) > 10,
            coalesce(e.n, 0) > coalesce(c.n, 0) * 2, coalesce(inconsistent, false), NOT has_tests, security_issues > 0]) AS holds,
          unnest([10, 11, 12, 13, 14, 15, 16]) AS nth,
          unnest(['documentation', 'complexity', 'architecture', 'architecture', 'naming', 'testing', 'security']) AS type,
          unnest([{", ".join(_str(C.REVIEW_RECOMMENDATIONS[k]) for k in C.REVIEW_RECOMMENDATIONS)}]) AS message
        FROM ratings r LEFT JOIN (SELECT project, count(*) AS n FROM component_pairs GROUP BY project) e USING (project)
          LEFT JOIN (SELECT project, count(*) AS n FROM dirs WHERE file_count >= 2 GROUP BY project) c USING (project)
          LEFT JOIN naming USING (project) LEFT JOIN tested USING (project)) a WHERE holds""",
    "advice": """SELECT project, row_number() OVER (PARTITION BY project ORDER BY nth) - 1 AS nth, type, message
      FROM (SELECT * FROM ai_advice UNION ALL SELECT * FROM own_advice) a""",

    # edges
    "targets": "SELECT DISTINCT project, path, name, target FROM (" + " UNION ALL ".join(
        f"SELECT project, path, name, regexp_extract(name, {_re2(p)}, 1) AS target FROM import_texts"
        for p in C.IMPORT_TARGETS) + ") a WHERE target <> ''",
    "edges": """SELECT DISTINCT t.project, t.path AS src, f.path AS dst FROM targets t JOIN dir_files f
      ON f.project = t.project AND (f.stem = t.target OR f.stem = regexp_extract(t.target, '([^.]*)$', 1))""",
    "bare_targets": """SELECT project, path, target FROM targets UNION SELECT project, path,
        regexp_replace(name, '^.*/', '') FROM import_texts WHERE NOT regexp_matches(name, '\\s')""",
    "bare_edges": """SELECT DISTINCT t.project, t.path AS src, f.path AS dst FROM bare_targets t JOIN dir_files f
      ON f.project = t.project AND (f.stem = t.target OR f.stem = regexp_extract(t.target, '([^.]*)$', 1))""",
    "component_pairs": """SELECT DISTINCT project, coalesce(nullif(replace(ltrim(source_dir, '/'), '/', '.'), ''), 'root') AS source,
        coalesce(nullif(replace(ltrim(target_dir, '/'), '/', '.'), ''), 'root') AS target
      FROM (SELECT i.project, s.dir AS source_dir, i.name, min_by(d.dir, d.dir_ord) AS target_dir
            FROM targets i JOIN dir_files s ON s.project = i.project AND s.path = i.path
              JOIN dirs d ON d.project = i.project AND d.dir <> s.dir
            WHERE EXISTS (SELECT 1 FROM dir_files f WHERE f.project = d.project AND f.dir = d.dir
                AND (f.stem = i.target OR f.stem = regexp_extract(i.target, '([^.]*)$', 1)))
              OR list_contains(string_split(i.target, '.'), nullif(regexp_extract(rtrim(d.dir, '/'), '([^/]*)$', 1), ''))
            GROUP BY ALL) a""",
    "class_rows": "SELECT project, path, name, line, bases FROM elements WHERE type = 'class'",
    "class_pairs": """SELECT DISTINCT project, child, parent FROM (
        SELECT project, name AS child, unnest(string_split(max_by(bases, path || '#' || lpad(CAST(line AS VARCHAR), 9, '0')), ',')) AS parent
        FROM class_rows WHERE coalesce(bases, '') <> '' GROUP BY project, name) a
      WHERE EXISTS (SELECT 1 FROM class_rows c WHERE c.project = a.project AND c.name = a.parent)""",

    # similarity
    "docs": """SELECT 'documents' AS project, 'd' || doc_id AS path, text AS content FROM documents""",

    # copies
    "passages": """SELECT concat_ws('/', source, lang) AS project, 'd' || doc_id AS path, text AS content, doc_id AS own FROM documents
      UNION ALL SELECT 'benchmark', 'b' || item_id, text, NULL FROM benchmark""",
    "passage_words": """SELECT project, path, own, line, w, row_number() OVER (PARTITION BY project, path ORDER BY line, k) - 1 AS at_
      FROM (SELECT project, path, own, line, unnest(ws) AS w, generate_subscripts(ws, 1) AS k
            FROM (SELECT project, path, own, line, regexp_extract_all(lower(l), '[\\p{L}\\p{N}_]+') AS ws
                  FROM (SELECT project, path, own, unnest(string_split(content, chr(10))) AS l,
                          generate_subscripts(string_split(content, chr(10)), 1) AS line FROM passages) a) b) c""",
    "passage_runs": """SELECT project, path, own, at_, array_to_string(ws, ' ') AS run, line AS first_, last_
      FROM (SELECT project, path, own, at_, line, list(w) OVER t AS ws, max(line) OVER t AS last_ FROM passage_words
            WINDOW t AS (PARTITION BY project, path ORDER BY at_ ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) a
      WHERE len(ws) = 10""",
    "source_places": """SELECT own AS source, run, min(at_) AS s_at, arg_min(first_, at_) AS s_first, arg_min(last_, at_) AS s_last
      FROM passage_runs WHERE own IS NOT NULL GROUP BY ALL""",
    "copied_runs": """SELECT * FROM (SELECT p.*, source, s_at, s_first, s_last, row_number() OVER (
          PARTITION BY project, path, at_ ORDER BY source) AS nth
        FROM passage_runs p JOIN source_places s ON p.run = s.run AND source IS DISTINCT FROM own) a WHERE nth = 1""",
    "copied": """SELECT project, path, min(source) AS source, CAST(sum(gain) AS BIGINT) AS n_copied
      FROM (SELECT *, least(10, coalesce(at_ - lag(at_) OVER (PARTITION BY project, path ORDER BY at_), 10)) AS gain
            FROM copied_runs) a GROUP BY ALL""",
    "copied_places": """SELECT project, path, source, min(first_) AS first_line, max(last_) AS last_line,
        min(s_first) AS source_first_line, max(s_last) AS source_last_line, count(*) + 9 AS n_words
      FROM (SELECT *, at_ - s_at AS off_, at_ - row_number() OVER (PARTITION BY project, path, source, at_ - s_at ORDER BY at_) AS isle
            FROM copied_runs) a GROUP BY project, path, source, off_, isle""",
    "openings": """SELECT project, path, content, lower(array_to_string(list_slice(
        string_split(regexp_replace(content, '\\n$', ''), chr(10)), 1, 10), ' ')) AS q FROM passages""",
    "copies": """SELECT o.project, o.path, min(d.doc_id) AS source FROM openings o JOIN documents d
      ON contains(lower(d.text), o.q) WHERE regexp_matches(o.q, '\\S') GROUP BY ALL""",

    # questions
    "asked": FX.QUESTIONS,
    "routed_raw": "SELECT qid, project, trim(lower(text)) AS q, CASE " + " ".join(
        f"WHEN regexp_matches(trim(lower(text)), {_re2(p)}) THEN '{n}'" for n, p in C.QUESTION_PATTERNS)
        + " ELSE 'generic' END AS intent FROM asked",
    "routed": r"""SELECT qid, project, intent, CASE intent
        WHEN 'what' THEN trim(regexp_extract(q, 'what (does|is) ([^?]+?)( do| for)?\s*(?:\?|$)', 2))
        WHEN 'how' THEN trim(regexp_extract(q, 'how (does|is|are) ([^?]+?)( work| implemented)?\s*(?:\?|$)', 2))
        WHEN 'where' THEN trim(regexp_extract(q, 'where is ([^?]+?)( used| called| implemented| defined)?\s*(?:\?|$)', 1))
        WHEN 'why' THEN trim(regexp_extract(q, 'why (does|is) ([^?]+)', 2))
        WHEN 'list' THEN trim(regexp_extract(q, 'list all ([^?]+)', 1))
        WHEN 'explain' THEN trim(regexp_extract(q, 'explain ([^?]+)', 1))
        WHEN 'compare' THEN trim(regexp_extract(q, 'compare ([^?]+) (?:with|and|to) ([^?]+)', 1)) END AS subject,
        CASE WHEN intent = 'where' THEN trim(regexp_extract(q, 'where is ([^?]+?)( used| called| implemented| defined)?\s*(?:\?|$)', 2)) END AS action,
        CASE WHEN intent = 'compare' THEN trim(regexp_extract(q, 'compare ([^?]+) (?:with|and|to) ([^?]+)', 2)) END AS subject2
      FROM routed_raw""",
    "things": """SELECT project, path, -1 AS ord, 'file' AS type, path AS name, 1 AS line, 'File: ' || path AS context,
        NULL AS params, NULL AS bases, NULL AS methods FROM meta
      UNION ALL SELECT project, path, row_number() OVER (PARTITION BY project, path ORDER BY line, found) AS ord, type, name, line,
        upper(type[1]) || type[2:] || ': ' || name, params, bases, methods FROM elements""",
    "subjects": """SELECT DISTINCT project, subject FROM routed WHERE subject IS NOT NULL
      UNION SELECT project, subject2 FROM routed WHERE subject2 IS NOT NULL""",
    "hits": """SELECT t.*, s.subject, CASE WHEN lower(t.name) = s.subject THEN 0 ELSE 1 END AS partial
      FROM things t JOIN subjects s ON s.project = t.project AND contains(lower(t.name), s.subject)""",
    "best": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, subject
        ORDER BY partial, path, ord) AS nth FROM hits) a WHERE nth = 1""",
    "usage_raw": """SELECT project, path, unnest(string_split(lower(content), chr(10))) AS text,
        generate_subscripts(string_split(lower(content), chr(10)), 1) AS line FROM meta""",
    "usage": """SELECT DISTINCT u.project, s.subject, u.path, u.line FROM usage_raw u JOIN (SELECT DISTINCT project, subject
          FROM routed WHERE intent = 'where' AND action IN ('used', 'called')) s ON s.project = u.project
        AND contains(u.text, s.subject) AND regexp_matches(u.text, '\\b' || s.subject || '\\b')""",
    "file_lines": """SELECT project, path, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS lines,
        string_split(content, chr(10)) AS split_lines, content FROM meta""",
    "descriptions": """SELECT s.project, s.path, 'File ''' || s.path || ''' (' || s.language || ')' ||
        CASE WHEN n_class + n_function + n_import > 0 THEN ' contains ' || concat_ws(', ',
          CASE WHEN n_class > 0 THEN n_class || ' classes' END, CASE WHEN n_function > 0 THEN n_function || ' functions' END,
          CASE WHEN n_import > 0 THEN n_import || ' imports' END) ELSE '' END || '. Summary: ' || summary AS answer
      FROM sentences s JOIN figures f USING (project, path)""",
    "element_texts": """SELECT project, subject, upper(type[1]) || type[2:] || ' ''' || name || ''' is defined in ' || path
        || ' at line ' || line || CASE WHEN type = 'function' THEN ' with parameters: ' || coalesce(nullif(replace(params, ',', ', '), ''), 'none') || '.'
          ELSE ' with bases: ' || coalesce(nullif(replace(bases, ',', ', '), ''), 'none') || '; methods: ' || coalesce(nullif(replace(methods, ',', ', '), ''), 'none') || '.' END AS answer
      FROM best WHERE type IN ('function', 'class')""",
    "mentions": """SELECT s.project, s.subject, l.path, list_position(list_transform(l.split_lines,
          lambda x: contains(lower(x), s.subject)), true) AS line, l.split_lines AS lines
      FROM subjects s JOIN file_lines l ON l.project = s.project AND contains(lower(l.content), s.subject)""",
    "all_mentions": """SELECT * FROM (SELECT s.project, s.subject, l.path, l.split_lines AS lines,
          unnest(range(1, len(l.split_lines) + 1)) AS line
        FROM subjects s JOIN file_lines l ON l.project = s.project AND contains(lower(l.content), s.subject)) m
      WHERE contains(lower(lines[line]), subject)""",
    "all_near": """SELECT project, subject, array_to_string(lines[greatest(1, line - 3):line + 2], chr(10)) AS context FROM all_mentions""",
    "all_wide": """SELECT project, subject, array_to_string(lines[greatest(1, line - 5):line + 4], chr(10)) AS context FROM all_mentions""",
    "near": """SELECT project, subject, path, line, array_to_string(lines[greatest(1, line - 3):line + 2], chr(10)) AS context
      FROM mentions WHERE line IS NOT NULL AND line > 0""",
    "concept_texts": """SELECT s.project, s.subject, CASE WHEN n IS NULL THEN 'I couldn''t find any information about '''
          || s.subject || ''' in the code.' ELSE 'Based on the code, ''' || s.subject || ''' appears to be ' || CASE
            WHEN cls THEN 'a class or object that ' || CASE WHEN init THEN 'initializes with some parameters and ' ELSE '' END
            WHEN fun THEN 'a function that ' WHEN imp THEN 'a module or library that '
            WHEN var THEN 'a variable that stores ' ELSE 'a concept related to ' END
          || 'is used in the project for functionality related to ' || s.subject || '.' END AS answer,
        least(coalesce(held, 0), 3) AS n_refs
      FROM subjects s LEFT JOIN (SELECT project, subject, count(*) AS held FROM near GROUP BY ALL) h USING (project, subject)
        LEFT JOIN (SELECT project, subject, count(*) AS n, bool_or(contains(context, 'class')) AS cls,
          bool_or(contains(context, 'def __init__')) AS init, bool_or(contains(context, 'def ' || subject)) AS fun,
          bool_or(contains(context, 'import') AND contains(context, subject)) AS imp,
          bool_or(contains(context, '=') AND contains(split_part(context, '=', 1), subject)) AS var
        FROM all_near GROUP BY ALL) c USING (project, subject)""",
    "wide": """SELECT project, subject, path, line, array_to_string(lines[greatest(1, line - 5):line + 4], chr(10)) AS context, ref_no
      FROM (SELECT *, row_number() OVER (PARTITION BY project, subject ORDER BY path) AS ref_no FROM mentions) a
      WHERE ref_no <= 3 AND line IS NOT NULL AND line > 0""",
    "topic_texts": """SELECT s.project, s.subject, CASE WHEN n IS NULL THEN 'I couldn''t find any code related to '''
          || s.subject || ''' in the project.' ELSE 'Here''s an explanation of ''' || s.subject || ''':' || chr(10) || chr(10)
          || 'Based on the code, this appears to be ' || CASE WHEN cls THEN 'a class that handles ' || s.subject || ' functionality.'
            WHEN fun THEN 'a function or method related to ' || s.subject || '.' ELSE 'code related to ' || s.subject || '.' END END AS answer,
        coalesce(shown, 0) AS n_refs
      FROM subjects s LEFT JOIN (SELECT project, subject, count(*) AS n, bool_or(contains(lower(context), 'class')) AS cls,
          bool_or(regexp_matches(lower(context), 'function|def')) AS fun FROM all_wide GROUP BY ALL) c USING (project, subject)
        LEFT JOIN (SELECT project, subject, count(*) AS shown FROM wide GROUP BY ALL) w USING (project, subject)""",
    "listing": """SELECT project, 'file' AS kind, path, 0 AS ord, 0 AS line, path AS context FROM meta
      UNION ALL SELECT project, type, path, found, CASE WHEN type = 'import' THEN 0 ELSE line END, name
        FROM (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY line, found) AS seq FROM elements) e
        WHERE type IN ('function', 'class', 'import')""",
    "list_asked": """SELECT qid, project, subject, CASE WHEN regexp_matches(subject, 'function|method') THEN 'function'
        WHEN contains(subject, 'class') THEN 'class' WHEN contains(subject, 'file') THEN 'file'
        WHEN contains(subject, 'import') THEN 'import' END AS kind FROM routed WHERE intent = 'list'""",
    "blocks_raw": """SELECT b.*, l.lines, len(regexp_extract(l.lines[b.line], '^\\s*')) AS level,
        l.lines[b.line + 1:] AS rest FROM things_used b JOIN file_lines l USING (project, path)""",
    "blocks": """SELECT * EXCLUDE (rest), CASE WHEN type = 'file' THEN lines
          WHEN coalesce(list_position(list_transform(rest, lambda x: trim(x) <> '' AND len(regexp_extract(x, '^\\s*')) <= level), true), 0) > 0
          THEN rest[1:list_position(list_transform(rest, lambda x: trim(x) <> '' AND len(regexp_extract(x, '^\\s*')) <= level), true) - 1]
          ELSE rest END AS body FROM blocks_raw""",
}


def build(final: str, **overrides: str) -> str:
    """``WITH`` every step the statement mentions, directly or through another step."""
    steps = {**STEPS, **overrides}
    ordered: list[str] = []

    def pull(text: str, trail: tuple[str, ...]) -> None:
        for name in steps:
            if name not in ordered and name not in trail and re.search(
                    rf"(?:FROM|JOIN)\s+{name}\b", text):
                pull(steps[name], (*trail, name))
                ordered.append(name)

    pull(final, ())
    if not ordered:
        return final
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({steps[n]})" for n in ordered) + "\n" + final


# --- statements -----------------------------------------------------------------------

_CODE = {"files": FX.CODE_FILES}
_P = "project, path"


def _of(table: str, kind: str, *more: str) -> str:
    columns = ", ".join([_P, "name", "line", *more])
    return build(f"SELECT {columns} FROM {table} WHERE type = '{kind}'")


def _of_python(kind: str, *more: str) -> str:
    """All Python files; what the parser would reject has generic elements."""
    columns = ", ".join([_P, "name", "line", "parse_ok", *more])
    return build(f"""SELECT {columns} FROM (SELECT e.*, NOT broken AS parse_ok FROM elements e
      JOIN meta USING (project, path) WHERE language = 'Python') x WHERE type = '{kind}'""")


def _figure(*columns: str) -> str:
    return build(f"SELECT {_P}, {', '.join(columns)} FROM figures")


def _rule(name: str) -> str:
    return build(f"SELECT {_P}, line FROM findings WHERE type = '{name}'")


def _q(final: str, **more: str) -> str:
    return build(final, **{**_CODE, **more})


_ASKED_WHERE = "FROM routed r LEFT JOIN {found} f USING (project, subject)"
_PLACES = """CASE WHEN n IS NULL THEN 'I couldn''t find ''' || subject || ''' in the codebase.'
    WHEN n = 1 THEN '''' || subject || ''' is located in ' || path || ' at line ' || line || '.'
    ELSE '''' || subject || ''' is found in ' || n || ' locations:' END AS answer, coalesce(n, 0) AS n_refs"""
_COUNTED = "(SELECT project, subject, count(*) AS n, min(path) AS path, min(line) AS line FROM {0} GROUP BY ALL)"
_USED = "intent = 'where' AND action IN ('used', 'called')"
_DEFINED = "intent = 'where' AND action NOT IN ('used', 'called')"
_BYTES = """CASE doc_id % 5 WHEN 1 THEN encode(text) || '\\x00'::BLOB
    WHEN 2 THEN '\\xFF'::BLOB || encode(text) ELSE encode(text) END"""
_DOC_WORDS = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+')"


_VECTORS = {
    "tf": f"""SELECT project, path, term, count(*) AS tf FROM (SELECT project, path,
        unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM texts) a
      WHERE term NOT IN ({_STOP}) GROUP BY ALL""",
    "terms": "SELECT project, term, count(*) AS df FROM tf GROUP BY project, term",
    "sizes": "SELECT project, count(*) AS n FROM texts GROUP BY project",
    "raw": """SELECT project, path, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w
      FROM tf JOIN terms USING (project, term) JOIN sizes USING (project)""",
    "unit": """SELECT project, path, term, w / sqrt(sum(w * w) OVER (PARTITION BY project, path)) AS w FROM raw""",
    "counted": "SELECT project, path, string_agg(term || ':' || tf, ' ' ORDER BY term) AS bag FROM tf GROUP BY ALL",
    "members": "SELECT project, path, min(path) OVER (PARTITION BY project, bag) AS first_ FROM counted",
}


def _similar(source: str, members: str = "") -> str:
    """Plain all-terms form: every shared term of every pair is summed."""
    return build(f"""
SELECT project, least(p1, p2) AS file1, greatest(p1, p2) AS file2, {py_round_sql('s', 2)} AS similarity
FROM (SELECT a.project, a.path AS p1, b.path AS p2, round(sum(a.w * b.w), 9) AS s
      FROM unit a JOIN unit b ON a.project = b.project AND a.term = b.term AND a.path < b.path
      GROUP BY ALL) pairs
WHERE s > 0.7 AND s < 0.99{members}""", texts=f"SELECT project, path, content FROM {source}", **_VECTORS)


def _run_list(words: str) -> str:
    return (f"list_distinct(list_transform(range(1, greatest(len({words}) - 3, 1)), "
            f"lambda i: array_to_string({words}[i:i + 4], ' ')))")


def _gram_sets(left: str, right: str) -> str:
    """One row with the distinct five-word runs ``a`` and ``b`` of two texts."""
    words = lambda t: f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+')"
    return (f"(SELECT {_run_list('wa')} AS a, {_run_list('wb')} AS b "
            f"FROM (SELECT {words(left)} AS wa, {words(right)} AS wb) w)")


_SHARED = "len(list_intersect(a, b))"
_UNION = "(len(a) + len(b) - len(list_intersect(a, b)))"
_CODED = f"""SELECT *, {_run_list('wa')} AS grams FROM (SELECT *, regexp_extract_all(lower(code), '[\\p{{L}}\\p{{N}}_]+') AS wa
  FROM (SELECT *, array_to_string(list_concat([lines[greatest(line, 1)]], body), chr(10)) AS code FROM blocks) c) d"""


def _pairs(kind: str) -> dict[str, str]:
    return {"files": FX.FORKED_FILES, "coded": _CODED,
            "things_used": f"SELECT *, lower(name) AS subject FROM things WHERE type = '{kind}'",
            "first_named": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject
              ORDER BY project, path, line) AS nth_ FROM coded) n WHERE nth_ = 1"""}


def _against_first(answer: str) -> str:
    return f"""SELECT x.subject, x.project AS project1, x.path AS path1, x.line AS line1, y.project AS project2,
        y.path AS path2, y.line AS line2, {answer} AS answer
      FROM coded x JOIN first_named y ON x.subject = y.subject
        AND (x.project <> y.project OR x.path <> y.path OR x.line <> y.line)"""


_BOTH = {"return": "Both functions return values.", "if": "Both functions contain conditional logic.",
         "for": "Both functions contain loops.", "try": "Both functions include error handling."}


def _function_answer(a: str = "x", b: str = "y") -> str:
    both = ", ".join(f"CASE WHEN contains({a}.code, '{w}') AND contains({b}.code, '{w}') THEN '{t}' END"
                     for w, t in _BOTH.items())
    shown = lambda t: f"coalesce(nullif(replace({t}.params, ',', ', '), ''), 'none')"
    shared = f"len(list_intersect({a}.grams, {b}.grams))"
    union = f"(len({a}.grams) + len({b}.grams) - {shared})"
    ratio = f"(CASE WHEN {union} > 0 THEN {shared} / {union}::DOUBLE ELSE 0 END)"
    return f"""concat_ws(' ', 'Functions ''' || {a}.name || ''' and ''' || {b}.name || ''' are ' ||
        CAST({py_round_sql(f'({ratio}) * 100', 1)} AS VARCHAR) || '% similar.',
      CASE WHEN coalesce({a}.params, '') = coalesce({b}.params, '') THEN 'Both functions take the same parameters: ' || {shown(a)} || '.'
        ELSE '''' || {a}.name || ''' takes parameters: ' || {shown(a)} || '. ''' || {b}.name || ''' takes parameters: ' || {shown(b)} || '.' END,
      CASE WHEN {ratio} > 0.7 THEN 'These functions appear to be related or different versions of the same functionality.' END,
      {both})"""


def _class_answer(a: str = "x", b: str = "y") -> str:
    names = lambda t: f"list_filter(string_split(coalesce({t}.methods, ''), ','), lambda v: v <> '')"
    one, two = names(a), names(b)
    common = f"list_sort(list_distinct(list_intersect({one}, {two})))"
    only = lambda p, q: f"list_sort(list_distinct(list_filter({p}, lambda v: NOT list_contains({q}, v))))"
    total = f"len(list_distinct(list_concat({one}, {two})))"
    part = lambda l, head: f"CASE WHEN len({l}) > 0 THEN {head} || array_to_string({l}, ', ') || '.' END"
    percent = py_round_sql(f"len({common}) / {total}::DOUBLE * 100", 1)
    head = lambda t: f"'Methods only in ''' || {t}.name || ''': '"
    return f"""concat_ws(' ', 'Classes ''' || {a}.name || ''' and ''' || {b}.name || ''' share ' ||
        CAST(CASE WHEN {total} > 0 THEN {percent} ELSE 0.0 END AS VARCHAR) || '% of their methods.',
      {part(common, "'Common methods: '")}, {part(only(one, two), head(a))}, {part(only(two, one), head(b))})"""


_FILE_SETS = """SELECT m.project, m.path, coalesce(list_sort(list_distinct(list(name) FILTER (name IS NOT NULL))), []) AS names
  FROM meta m LEFT JOIN elements e ON e.project = m.project AND e.path = m.path GROUP BY ALL"""


def _file_answer(a: str, b: str) -> str:
    """Comparison of two files given aliases of file_sets rows ``a``/``b`` and counts ``a``c/``b``c."""
    common = f"list_sort(list_intersect({a}.names, {b}.names))"
    total = f"len(list_distinct(list_concat({a}.names, {b}.names)))"
    percent = py_round_sql(f"len({common}) / {total}::DOUBLE * 100", 1)
    kinds = ", ".join(
        f"""CASE WHEN {a}c.n_{k} > 0 OR {b}c.n_{k} > 0 THEN '''' || {a}.path || ''' has ' || {a}c.n_{k}
          || ' {k}s, ''' || {b}.path || ''' has ' || {b}c.n_{k} || '.' END"""
        for k in ("class", "function", "import", "variable"))
    return f"""concat_ws(' ', 'Files ''' || {a}.path || ''' and ''' || {b}.path || ''' share ' ||
        CAST(CASE WHEN {total} > 0 THEN {percent} ELSE 0.0 END AS VARCHAR) || '% of their code elements.',
      {kinds}, CASE WHEN len({common}) > 0 THEN 'Common elements include: ' || array_to_string({common}[1:5], ', ')
        || CASE WHEN len({common}) > 5 THEN ' and ' || (len({common}) - 5) || ' others' ELSE '.' END END)"""


_BEST_USED = {"things_used": "SELECT * FROM best WHERE type IN ('function', 'class', 'file')",
              "coded": _CODED}
_LINE_CASES = " ".join(
    f"WHEN regexp_matches(text, {_str(p)}) THEN '{s}'" for p, s in (
        (r"^\s*def\s+\w+\s*\(", "This defines a function."),
        (r"^\s*class\s+\w+", "This defines a class."),
        (r"^\s*if\s+", "This is a conditional statement."),
        (r"^\s*for\s+", "This is a loop statement."),
        (r"^\s*return\s+", "This returns a value from a function."),
        (r"^\s*import\s+|^\s*from\s+\w+\s+import", "This imports external modules or functions.")))
_WORD_COUNT = ("len(list_filter(regexp_extract_all(array_to_string(body, chr(10)), '\\w+'), "
               "lambda w: w IN ({0})))")
_WHY = """SELECT project, subject, lines, line, coalesce(list_position(list_transform(list_reverse(lines[1:line - 1]),
    lambda x: regexp_matches(x, '^\\s*(#|//|/\\*|\\*)')), false), 0) AS stop FROM best b JOIN file_lines l USING (project, path)"""

_ANSWERS = {
    "what": f"""SELECT r.qid, coalesce(e.answer, d.answer, c.answer) AS answer FROM routed r
      LEFT JOIN best b ON b.project = r.project AND b.subject = r.subject AND b.type IN ('function', 'class', 'file')
      LEFT JOIN element_texts e ON e.project = r.project AND e.subject = r.subject
      LEFT JOIN descriptions d ON b.type = 'file' AND d.project = b.project AND d.path = b.path
      LEFT JOIN concept_texts c ON c.project = r.project AND c.subject = r.subject WHERE intent = 'what'""",
    "how": f"""SELECT r.qid, coalesce(upper(type[1]) || type[2:] || ' ''' || name || ''' has ' || len(body) || ' lines, '
        || {_WORD_COUNT.format("'if', 'elif', 'else', 'switch', 'case'")} || ' branches, '
        || {_WORD_COUNT.format("'for', 'while'")} || ' loops and ' || {_WORD_COUNT.format("'return'")} || ' returns.',
        'I don''t have enough information to explain how ''' || r.subject || ''' works in this codebase.') AS answer
      FROM routed r LEFT JOIN blocks b ON b.project = r.project AND b.subject = r.subject WHERE intent = 'how'""",
    "defined": f"SELECT qid, {_PLACES} FROM routed r LEFT JOIN {_COUNTED.format('hits')} f USING (project, subject) WHERE {_DEFINED}",
    "used": f"SELECT qid, {_PLACES} FROM routed r LEFT JOIN {_COUNTED.format('usage')} f USING (project, subject) WHERE {_USED}",
    "why": """SELECT r.qid, CASE WHEN said <> '' THEN 'The code documentation suggests: ' || said ELSE
        'I don''t have enough information to explain why ''' || r.subject || ''' is implemented this way.' END AS answer
      FROM routed r LEFT JOIN (SELECT project, subject, array_to_string(list_transform(
          lines[CASE WHEN stop > 0 THEN line - stop + 1 ELSE 1 END:line - 1], lambda x: trim(regexp_replace(regexp_replace(x,
            '^\\s*(?:#+|//+|/\\*+|\\*+/?)\\s*', ''), '\\s*\\*/\\s*$', ''))), ' ') AS said FROM reasons) w
        USING (project, subject) WHERE intent = 'why'""",
    "list": """SELECT qid, CASE WHEN n IS NULL THEN 'No ' || subject || ' found in the codebase.' ELSE 'Found ' || n || ' '
        || subject || ':' END AS answer, coalesce(n, 0) AS n_refs FROM list_asked LEFT JOIN (SELECT project, kind, count(*) AS n
        FROM listing GROUP BY ALL) l USING (project, kind)""",
    "compare": f"""SELECT r.qid, CASE WHEN x.type IS NULL OR y.type IS NULL THEN 'I couldn''t find enough information to compare '''
          || r.subject || ''' and ''' || r.subject2 || '''.'
        WHEN x.type <> y.type THEN 'Cannot compare ' || r.subject || ' (' || x.type || ') with ' || r.subject2 || ' (' || y.type
          || ') as they are different types.'
        WHEN x.type = 'function' THEN {_function_answer()}
        WHEN x.type = 'class' THEN {_class_answer()}
        WHEN x.type = 'file' THEN {_file_answer('xf', 'yf')}
        ELSE 'Both ''' || r.subject || ''' and ''' || r.subject2 || ''' are ' || x.type || 's, but I cannot provide a detailed comparison.' END AS answer
      FROM routed r LEFT JOIN coded x ON x.project = r.project AND x.subject = r.subject
        LEFT JOIN coded y ON y.project = r.project AND y.subject = r.subject2
        LEFT JOIN file_sets xf ON xf.project = x.project AND xf.path = x.path
        LEFT JOIN file_sets yf ON yf.project = y.project AND yf.path = y.path
        LEFT JOIN figures xfc ON xfc.project = x.project AND xfc.path = x.path
        LEFT JOIN figures yfc ON yfc.project = y.project AND yfc.path = y.path
      WHERE intent = 'compare'""",
}
_COMPARE_STEPS = {"things_used": "SELECT * FROM best", "coded": _BEST_USED["coded"],
                  "file_sets": _FILE_SETS}

_STORED_RUNS = build(f"""SELECT 'day1' AS run, project, path, meta.language, line_count, sha256(meta.content) AS digest, 'day1' AS stored
    FROM figures JOIN meta USING (project, path)
  UNION ALL SELECT 'day2', project, path, language, CASE WHEN changed THEN line_count + 1 ELSE line_count END, sha256(l.content),
    CASE WHEN changed THEN 'day2' ELSE 'day1' END
    FROM (SELECT project, path, meta.language, line_count, later.content, later.content <> meta.content AS changed
          FROM figures JOIN meta USING (project, path) JOIN ({FX.LATER_FILES}) later USING (project, path)) l""",
                     files=FX.CODE_FILES)

ORACLES: dict[str, str] = {
    "s02_drop_binary": f"""SELECT doc_id FROM (SELECT doc_id, hex({_BYTES}) AS h FROM documents) a
      WHERE NOT regexp_matches(h, '^(?:[0-9A-F][0-9A-F])*00') AND TRY(decode(unhex(h))) IS NOT NULL""",
    "s03_decode_text": """SELECT doc_id, md5(regexp_replace(text, '\\r\\n?', chr(10), 'g')
        || CASE WHEN doc_id % 3 = 0 THEN chr(65533) || chr(65533) ELSE '' END) AS digest FROM documents""",
    "s04_code_gate": build("SELECT project, path FROM meta WHERE language <> 'Unknown'"),
    "s05_admit_upload": f"""WITH uploads AS ({FX.UPLOADS}), eligible AS (SELECT *, row_number() OVER (
          PARTITION BY project ORDER BY ord) AS position FROM uploads WHERE contains(name, '.')
          AND lower(regexp_extract(name, '([^.]*)$', 1)) IN ({", ".join(_str(e) for e in C.UPLOAD_EXTENSIONS)})
          AND size <= {C.MAX_UPLOAD_FILE_BYTES}), running AS (SELECT *, sum(size) OVER (PARTITION BY project
          ORDER BY ord ROWS UNBOUNDED PRECEDING) AS total FROM eligible)
      SELECT project, ord, name, position, CAST(total AS BIGINT) AS total FROM running
      WHERE position <= {C.MAX_UPLOAD_FILES} AND total <= {C.MAX_UPLOAD_TOTAL_BYTES}""",
    "s06_repo_catalog": f"""SELECT owner, repo, count(*) AS urls FROM (SELECT regexp_extract(url, {_re2(C.REPO_URL)}, 1) AS owner,
        regexp_extract(url, {_re2(C.REPO_URL)}, 2) AS repo FROM ({FX.REPO_URLS}) u) a WHERE owner <> '' GROUP BY ALL""",
    "s06_repo_rejects": f"SELECT url FROM ({FX.REPO_URLS}) u WHERE NOT regexp_matches(url, {_re2(C.REPO_URL)})",
    "s07_results_json": build("""SELECT project, path, '{"path":"' || path || '","language":"' || language || '","size":' || size
        || ',"line_count":' || line_count || ',"quality_score":' || quality_score || '}' AS json FROM figures"""),
    "s07_stored_runs": _STORED_RUNS,
    "s07_stored_summaries": f"""SELECT run, project, count(*) AS file_count, CAST(sum(line_count) AS BIGINT) AS line_count
      FROM ({_STORED_RUNS}) r GROUP BY ALL""",
    "s08_file_lookup": build(f"SELECT project, path, line_count FROM figures SEMI JOIN ({FX.STORED}) s USING (project, path)"),
    "s09_expired": """SELECT event_id, event_type FROM events
      WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOURS""",
    "s10_content_lookup": f"""WITH code AS ({FX.CODE_FILES}), asked AS ({FX.PATH_REQUESTS})
      SELECT project, request, path FROM (SELECT a.project, a.request, c.path, row_number() OVER (
          PARTITION BY a.project, a.request ORDER BY c.path <> a.request, c.path) AS nth
        FROM asked a JOIN code c ON c.project = a.project AND (ends_with(c.path, a.request) OR ends_with(a.request, c.path))) b
      WHERE nth = 1""",
    "e01_language_of": build("SELECT project, path, language FROM meta"),
    "e02_route_by_language": build("SELECT project, path, rules FROM meta"),
    "e03_first_line_of": build(f"SELECT project, path, {_first_line(_str('return'))} AS line FROM meta"),
    "e04_generic_imports": build(f"SELECT {_P}, name, line FROM gen_imports i SEMI JOIN (SELECT * FROM meta WHERE rules = 'generic') m USING (project, path)"),
    "e05_generic_classes": build(f"SELECT {_P}, name, line FROM gen_classes i SEMI JOIN (SELECT * FROM meta WHERE rules = 'generic') m USING (project, path)"),
    "e06_generic_functions": build(f"SELECT {_P}, name, line FROM gen_functions i SEMI JOIN (SELECT * FROM meta WHERE rules = 'generic') m USING (project, path)"),
    "e07_generic_variables": build(f"SELECT {_P}, name, line FROM gen_variables i SEMI JOIN (SELECT * FROM meta WHERE rules = 'generic') m USING (project, path)"),
    "e08_python_imports": _of_python("import"),
    "e09_python_classes": _of_python("class", "bases", "methods"),
    "e10_python_functions": _of_python("function", "params"),
    "e11_python_variables": _of_python("variable"),
    "e12_enclosing_header": build("SELECT project, path, line, in_class FROM py_headers",
                                  py_text=STEPS["py_text"].replace(" AND NOT broken", "")),
    "e13_python_exact": build("""SELECT project, path, NOT broken AS parse_ok, line, type, name, params, bases, methods
      FROM elements JOIN meta USING (project, path) WHERE language = 'Python'"""),
    "e14_js_imports": build(f"SELECT {_P}, name, line FROM js_imports"),
    "e15_js_classes": build(f"SELECT {_P}, name, line, extends FROM js_classes"),
    "e16_js_functions": build(f"SELECT {_P}, name, line FROM js_functions"),
    "e17_react_components": build(f"SELECT {_P}, name, line FROM js_components"),
    "e18_java_package": build(f"SELECT {_P}, name, line FROM java_packages"),
    "e19_java_imports": build(f"SELECT {_P}, name, line FROM java_imports"),
    "e20_java_classes": build(f"SELECT {_P}, name, line, extends, implements FROM java_classes"),
    "e21_java_methods": build(f"SELECT {_P}, name, line FROM java_methods"),
    "e22_elements": build("SELECT project, path, language, line, type, name, extends FROM elements JOIN meta USING (project, path)"),
    "m01_size": _figure("size"),
    "m02_line_count": _figure("line_count"),
    "m03_comment_lines": _figure("comment_count"),
    "m04_comment_ratio": _figure("comment_ratio"),
    "m05_summary": build(f"SELECT {_P}, summary FROM sentences"),
    "m06_cyclomatic": _figure("cyclomatic"),
    "m07_max_nested_depth": _figure("depth AS max_nested_depth"),
    "m08_complexity_rating": _figure("rating"),
    "m09_concepts": build(f"SELECT {_P}, rnk, word, cnt FROM concepts"),
    "m10_quality_score": _figure("quality_score"),
    "m11_suggestions": build(f"""SELECT project, path, CASE kind WHEN 'smell' THEN 'code_smell' ELSE 'security' END AS type,
        message, line, CASE kind WHEN 'smell' THEN 'medium' ELSE 'high' END AS priority FROM findings
      UNION ALL SELECT project, path, 'refactoring', {_str(C.REFACTOR_MESSAGE)}, NULL, 'medium' FROM figures WHERE rating = 'high'
      UNION ALL SELECT project, path, 'naming', {_str(C.NAMING_MESSAGE)}, NULL, 'low' FROM figures WHERE short_names"""),
    "m12_short_variables": _figure("short_names"),
    "m13_context_window": build("""SELECT project, path, i - 1 AS line, array_to_string(lines[greatest(1, i - 3):i + 2], chr(10)) AS context
      FROM (SELECT project, path, lines, unnest(range(1, len(lines) + 1)) AS i FROM file_lines) a WHERE contains(lines[i], 'return')"""),
    "document_metrics": f"""SELECT 'd' || doc_id AS path, strlen(text) AS size,
        len(text) - len(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS line_count,
        len(regexp_extract_all(text, {_re2(C.COMMENT, 'm')})) AS comment_count,
        len(list_filter({_DOC_WORDS}, lambda x: x IN ({", ".join(_str(w) for w in C.DECISION_WORDS)}))) AS cyclomatic,
        CAST(list_max(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN trim(x) = ''
          OR regexp_matches(x, '^\\s*(#|//|/\\*|\\*)') THEN 0 ELSE len(regexp_extract(x, '^\\s*')) // 4 END)) AS BIGINT) AS depth
      FROM documents""",
    **{f"f{i:02}_{r[0]}": _rule(r[0]) for i, r in zip((1, 2, 3), C.SMELL_RULES)},
    **{f"f{i:02}_{r[0]}": _rule(r[0]) for i, r in zip((5, 6, 7, 8), C.SECURITY_RULES)},
    "f04_too_many_arguments": build(f"SELECT {_P}, line, message FROM findings WHERE type = 'too_many_arguments'"),
    "f09_scan_rules": build(f"SELECT {_P}, kind, type, message, line, severity FROM findings"),
    "f10_security_scan": build("""SELECT project, path AS file, line, message AS issue_type, severity, 'medium' AS confidence
      FROM findings WHERE kind = 'security'"""),
    "f11_merge_insights": build(f"""SELECT project, path, coalesce(s.quality_score, f.quality_score) AS quality_score, smells
      FROM figures f LEFT JOIN ({FX.STORED}) s USING (project, path)"""),
    "f11_default_override": build("""SELECT project, path, 70 AS quality_score, 0 AS issues, 'Code Style' AS type, 1 AS line FROM figures"""),
    "a01_language_histogram": build("SELECT project, language, files FROM histogram"),
    "a02_project_totals": build("SELECT project, file_count, total_lines, total_elements, class_count, function_count FROM totals"),
    "a03_common_imports": build("SELECT * FROM top_imports"),
    "a04_main_languages": build("SELECT * FROM main_text"),
    "a05_project_text": build("SELECT * FROM project_text"),
    "a06_basic_summary": build("""SELECT project, CASE WHEN file_count IS NULL THEN 'No files were analyzed for this project.'
        ELSE 'This project contains ' || file_count || ' files primarily written in ' || language || '. It has ' || class_count
          || ' classes and ' || function_count || ' functions across ' || total_lines || ' lines of code.' END AS text,
        coalesce(file_count, 0) AS file_count, coalesce(total_lines, 0) AS total_lines, coalesce(class_count, 0) AS class_count,
        coalesce(function_count, 0) AS function_count
      FROM projects LEFT JOIN totals USING (project) LEFT JOIN (SELECT * FROM top_languages WHERE rnk = 1) l USING (project)"""),
    "a07_ai_quality": build("SELECT project, quality_score FROM quality"),
    "a08_project_concepts": build("SELECT * FROM project_words"),
    "a09_finding_counts": build("SELECT * FROM kinds"),
    "a10_ai_recommendations": build("""SELECT project, row_number() OVER (PARTITION BY project ORDER BY nth) - 1 AS nth, type, message
      FROM ai_advice"""),
    "a11_directory_metrics": build("SELECT project, dir, file_count FROM dirs"),
    "a11_directory_files": build("SELECT project, dir, file FROM dir_files"),
    "a12_components": build("""SELECT project, component_rank, coalesce(nullif(replace(dir, '/', '.'), '.'), 'root') AS name, file_count,
        (SELECT string_agg(file, ',' ORDER BY path) FROM (SELECT file, path FROM dir_files f WHERE f.project = b.project
           AND f.dir = b.dir ORDER BY path LIMIT 5) x) AS files FROM big_dirs b"""),
    "a13_quality_assessment": build("""SELECT project, comment_ratio, complexity, quality_score, code_smells, security_issues,
        documentation_rating, complexity_rating, overall_rating FROM ratings"""),
    "a14_naming_consistency": build("""SELECT t.project, coalesce(snake, 0) AS snake, coalesce(camel, 0) AS camel,
        coalesce(pascal, 0) AS pascal, coalesce(inconsistent, false) AS inconsistent FROM totals t LEFT JOIN naming USING (project)"""),
    "a15_has_tests": build("SELECT * FROM tested"),
    "a16_review_recommendations": build("SELECT * FROM advice"),
    "a17_project_review": build("""SELECT t.project, x.text, file_count, total_elements,
        coalesce((SELECT count(*) FROM component_pairs c WHERE c.project = t.project), 0) AS n_edges,
        coalesce((SELECT count(*) FROM edges e WHERE e.project = t.project), 0) AS n_file_edges,
        coalesce((SELECT count(*) FROM class_pairs p WHERE p.project = t.project), 0) AS n_class_edges,
        (SELECT files FROM histogram h WHERE h.project = t.project AND language = 'Python') AS python_files,
        (SELECT name FROM top_imports i WHERE i.project = t.project AND rnk = 1) AS top_import, quality_score,
        code_smells AS smell_types, (SELECT word FROM project_words w WHERE w.project = t.project AND rnk = 1) AS top_concept,
        (SELECT coalesce(nullif(replace(dir, '/', '.'), '.'), 'root') FROM big_dirs b WHERE b.project = t.project AND component_rank = 1) AS top_component,
        documentation_rating, (SELECT count(*) FROM advice a WHERE a.project = t.project) AS n_recommendations
      FROM totals t JOIN project_text x USING (project) JOIN ratings r USING (project)"""),
    "a17_review_entries": build("""SELECT project, 'import' AS part, rnk - 1 AS nth, name, cnt FROM top_imports
      UNION ALL SELECT project, 'concept', rnk - 1, word, cnt FROM project_words
      UNION ALL SELECT project, 'component', component_rank - 1, coalesce(nullif(replace(dir, '/', '.'), '.'), 'root'), file_count
        FROM big_dirs
      UNION ALL SELECT project, 'chart', rnk - 1, path, cyclomatic FROM (SELECT project, path, cyclomatic, row_number() OVER (
          PARTITION BY project ORDER BY cyclomatic DESC, path) AS rnk FROM figures) c WHERE rnk <= 15
      UNION ALL SELECT project, 'language', 0, language, files FROM histogram
      UNION ALL SELECT project, kind, 0, type, cnt FROM kinds"""),
    "a10_duplicate_advice": _q(f"""SELECT project, coalesce(n, 0) > 5 AS refactoring FROM totals
      LEFT JOIN (SELECT project, count(*) AS n FROM ({_similar('code')}) s GROUP BY project) p USING (project)"""),
    "a18_file_defaults": _q(f"""SELECT project, path, CASE WHEN s.path IS NULL THEN 75 ELSE 70 END AS quality_score,
        CASE WHEN s.path IS NULL THEN 5 ELSE cyclomatic END AS cyclomatic, 1 AS smells, 0 AS issues
      FROM figures LEFT JOIN ({FX.STORED}) s USING (project, path)"""),
    "a18_project_defaults": build("""SELECT project, coalesce(x.text, 'Analysis complete.') AS text, coalesce(file_count, 0) AS file_count,
        coalesce(total_lines, 0) AS total_lines, coalesce(class_count, 0) AS class_count, coalesce(function_count, 0) AS function_count,
        coalesce(quality_score, 0.0e0) AS quality_score, coalesce(security_issues, 0) AS security_types,
        coalesce(documentation_rating, 'unknown') AS documentation_rating, coalesce(complexity_rating, 'unknown') AS complexity_rating,
        coalesce(overall_rating, 'unknown') AS overall_rating
      FROM projects LEFT JOIN totals USING (project) LEFT JOIN project_text x USING (project) LEFT JOIN ratings USING (project)"""),
    "a19_element_counts": _figure("n_import", "n_class", "n_function", "n_variable", "n_method", "n_component", "n_package"),
    "j01_file_edges": build("SELECT * FROM edges"),
    "j01_file_edges_bare": build("SELECT * FROM bare_edges"),
    "j02_component_edges": build("SELECT * FROM component_pairs"),
    "j03_class_edges": build("SELECT * FROM class_pairs"),
    "j04_similar_documents": _similar("docs", """
  AND p1 IN (SELECT first_ FROM members) AND p2 IN (SELECT first_ FROM members)"""),
    "j04_document_classes": build("SELECT project, path, first_ AS \"first\" FROM members",
                                  texts="SELECT project, path, content FROM docs", **_VECTORS),
    "j04_similar_code": _similar("files"),
    "j05_copied_sources": build("""SELECT project, path, source IS NOT NULL AS found, source, coalesce(n_copied, 0) AS n_copied
      FROM passages LEFT JOIN copied USING (project, path)"""),
    "j05_copied_passages": build("SELECT * FROM copied_places"),
    "j05_copied_openings": build("""SELECT project, path, source IS NOT NULL AS found, source FROM passages LEFT JOIN copies USING (project, path)"""),
    "j06_percent_copied": build(f"""SELECT project, path, copied.source IS NOT NULL AS found, copied.source, coalesce((SELECT CAST(floor(
          CASE WHEN {_UNION} > 0 THEN {_SHARED} / {_UNION}::DOUBLE ELSE 0 END * 100) AS BIGINT)
          FROM {_gram_sets('p.content', 'd.text')} g WHERE copied.source IS NOT NULL), 0) AS percent_copied
      FROM passages p LEFT JOIN copied USING (project, path) LEFT JOIN documents d ON d.doc_id = copied.source"""),
    "j07_complexity_chart": build("""SELECT project, path, file, cyclomatic, rnk FROM (SELECT project, path, file, cyclomatic,
          row_number() OVER (PARTITION BY project ORDER BY cyclomatic DESC, path) AS rnk
        FROM figures JOIN dir_files USING (project, path)) a WHERE rnk <= 15"""),
    "j08_name_sets": build(f"""SELECT e.project, src, dst, len(list_intersect(a, b)) AS common,
        len(a) - len(list_intersect(a, b)) AS only_src, len(b) - len(list_intersect(a, b)) AS only_dst,
        {py_round_sql(f'{_SHARED} / {_UNION}::DOUBLE * 100', 1)} AS percent
      FROM bare_edges e JOIN (SELECT project, path AS src, names AS a FROM file_sets) x USING (project, src)
        JOIN (SELECT project, path AS dst, names AS b FROM file_sets) y USING (project, dst)""", file_sets=_FILE_SETS),
    "q01_route": _q("SELECT qid, project, intent, subject, action, subject2 FROM routed"),
    "q02_find_elements": _q("""SELECT project, subject, type, name, path, line, context FROM best SEMI JOIN (SELECT project, subject
        FROM routed WHERE intent IN ('what', 'where', 'compare')) r USING (project, subject)"""),
    "q03_where_defined": _q(_ANSWERS["defined"]),
    "q03_where_defined_refs": _q(f"""SELECT project, subject, path AS file, line, context FROM hits
      SEMI JOIN (SELECT project, subject FROM routed WHERE {_DEFINED}) r USING (project, subject)"""),
    "q04_where_used": _q(_ANSWERS["used"]),
    "q04_where_used_refs": _q(f"""SELECT project, subject, path AS file, line, 'Usage of ' || subject AS context FROM usage
      SEMI JOIN (SELECT project, subject FROM routed WHERE {_USED}) r USING (project, subject)"""),
    "q05_what_is": _q(_ANSWERS["what"]),
    "q06_how_works": _q(_ANSWERS["how"], **_BEST_USED),
    "q07_why_is": _q(_ANSWERS["why"], reasons=_WHY),
    "q08_list_all": _q(_ANSWERS["list"]),
    "q08_list_all_refs": _q("""SELECT qid, ref_no, path AS file, line, context FROM list_asked JOIN (SELECT *, row_number() OVER (
        PARTITION BY project, kind ORDER BY path, ord) AS ref_no FROM listing) l USING (project, kind) WHERE ref_no <= 10"""),
    "q09_describe_file": build("SELECT * FROM descriptions"),
    "q10_explain_line": _q(f"""SELECT qid, CASE WHEN path IS NULL THEN 'I couldn''t find a file matching ''' || file_name || '''.'
        WHEN line < 1 OR line > len(lines) THEN 'Line ' || line || ' is out of range for file ''' || path || '''.'
        ELSE 'Line ' || line || ' contains: ' || trim(text) || '. ' || CASE {_LINE_CASES} ELSE '' END END AS answer
      FROM (SELECT r.*, l.path, l.lines, l.lines[r.line] AS text FROM ({FX.LINE_REQUESTS}) r LEFT JOIN (SELECT * FROM (SELECT a.qid, f.path, f.lines,
          row_number() OVER (PARTITION BY a.qid ORDER BY f.path) AS nth FROM ({FX.LINE_REQUESTS}) a JOIN file_lines f
          ON f.project = a.project AND contains(f.path, a.file_name)) p WHERE nth = 1) l USING (qid)) x"""),
    "q11_compare_functions": build(_against_first(_function_answer()), **_pairs("function")),
    "q12_compare_classes": build(_against_first(_class_answer()), **_pairs("class")),
    "q13_compare_files": build(f"""SELECT e.project, e.src, e.dst, {_file_answer('xf', 'yf')} AS answer FROM bare_edges e
      JOIN file_sets xf ON xf.project = e.project AND xf.path = e.src JOIN file_sets yf ON yf.project = e.project AND yf.path = e.dst
      JOIN figures xfc ON xfc.project = e.project AND xfc.path = e.src JOIN figures yfc ON yfc.project = e.project AND yfc.path = e.dst""",
                               file_sets=_FILE_SETS),
    "q14_concepts": _q("""SELECT * FROM concept_texts SEMI JOIN (SELECT project, subject FROM routed
      WHERE intent IN ('what', 'explain', 'where')) r USING (project, subject)"""),
    "q14_concept_refs": _q("""SELECT project, subject, path, line, context, ref_no FROM (SELECT *, row_number() OVER (
        PARTITION BY project, subject ORDER BY path) AS ref_no FROM near SEMI JOIN (SELECT project, subject FROM routed
        WHERE intent IN ('what', 'explain', 'where')) r USING (project, subject)) a WHERE ref_no <= 3"""),
    "q15_explain_topics": _q("""SELECT * FROM topic_texts SEMI JOIN (SELECT project, subject FROM routed
      WHERE intent = 'explain') r USING (project, subject)"""),
    "q15_explain_topic_refs": _q("""SELECT project, subject, ref_no, path, line, context FROM wide SEMI JOIN (SELECT project, subject
      FROM routed WHERE intent = 'explain') r USING (project, subject)"""),
    "q16_compare": _q(_ANSWERS["compare"], **_COMPARE_STEPS),
}
ORACLES["answer_all"] = _q(f"""SELECT qid, intent, answer FROM routed r JOIN (
    SELECT qid, answer FROM ({_ANSWERS['what']}) w UNION ALL SELECT qid, answer FROM ({_ANSWERS['how']}) h
    UNION ALL SELECT qid, answer FROM ({_ANSWERS['defined']}) d UNION ALL SELECT qid, answer FROM ({_ANSWERS['used']}) u
    UNION ALL SELECT qid, answer FROM ({_ANSWERS['why']}) y UNION ALL SELECT qid, answer FROM ({_ANSWERS['list']}) l
    UNION ALL SELECT qid, t.answer FROM routed JOIN topic_texts t USING (project, subject) WHERE intent = 'explain'
    UNION ALL SELECT qid, answer FROM ({_ANSWERS['compare']}) c
    UNION ALL SELECT qid, 'I couldn''t analyze this query. Please try asking about something specific in the code.' FROM routed WHERE intent = 'generic'
  ) a USING (qid)""", reasons=_WHY, file_sets=_FILE_SETS, coded=_BEST_USED["coded"],
    things_used="SELECT * FROM best").replace(
        "LEFT JOIN blocks b ON b.project = r.project AND b.subject = r.subject WHERE",
        "LEFT JOIN blocks b ON b.project = r.project AND b.subject = r.subject AND b.type IN ('function', 'class', 'file') WHERE")
