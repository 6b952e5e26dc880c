"""Corpora derived from the given tables, as SQL both Spark and DuckDB run.

``~`` stands for a line feed and ``^`` for a single quote in the templates.
"""

_FILL = """replace(replace(replace(replace(replace(replace(replace(
    {body},
    '{{k}}', CAST(p_partkey AS VARCHAR(9))), '{{m}}', CAST(p_partkey % 7 AS VARCHAR(9))),
    '{{j}}', CAST((p_partkey * 3) % 50 AS VARCHAR(9))), '{{n}}', CAST(p_size AS VARCHAR(9))),
    '{{nm}}', p_name), '^', chr(39)), '~', chr(10))"""

_CODE_BODY = """CASE p_partkey % 6
      WHEN 0 THEN 'import os~from mod{m}.unit{j} import helper{j}~~# note about {nm}~class Item{k}(Base{m}):~    def get_size(self, a):~        if self.size > {n}00:~            for i in range(3):~                return hashlib.md5(i)~~def helper{k}(a, b, c, d, e, f):~    password = "{nm}-secret"~    return a~'
      WHEN 1 THEN 'import { thing } from ^./unit{j}^;~var lib{k} = require(^lib{m}^);~// {nm}~class View{k} extends Base{m} {~  render() { if (a && b || c && d) { while (x) { track({n}00); } } }~}~function drawItem{k}(x) { return x; }~var onClick{k} = (e) => { drawItem{k}(e); };~'
      WHEN 2 THEN 'package org.mod{m};~import java.util.List;~import org.mod{m}.Unit{j};~/* {nm} */~public class Part{k} extends Base{m} implements A, B {~    public int sizeOf(int x) { return {n}00; }~}~'
      WHEN 3 THEN 'package main~import fmt~// {nm}~func Run{k}() {~    id = 0~    total = id~    for i := 0; i < {n}00; i++ { if total > 3 { switch total { } } }~}~'
      WHEN 4 THEN 'from mod{m} import unit{j}~import hashlib~~LIMIT{m} = {n}000~def load_item{k}(cursor, name):~    # run the query~    cursor.execute("select %s" % name)~    os.system("rm " + name)~    if name:~        while True:~            pass~    return hashlib.sha1(name)~'
      ELSE concat('title = {nm}~struct Row{m}~  note {n}00~def big{k}(a) { ', repeat('step ', 120), '}~') END"""

_CODE_PATH = """concat('mod', CAST(p_partkey % 7 AS VARCHAR(9)), '/',
         CASE WHEN p_partkey % 11 = 0 THEN 'test_' ELSE '' END,
         'unit', CAST(p_partkey AS VARCHAR(9)),
         CASE p_partkey % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java'
                            WHEN 3 THEN '.go' WHEN 4 THEN '.py' ELSE '.xyz' END)"""

# One file per part: Python, JavaScript, Java, Go and an unknown language in seven projects.
CODE_FILES = f"""SELECT split_part(path, '/', 1) AS project, path, content FROM (
  SELECT {_CODE_PATH} AS path, {_FILL.format(body=_CODE_BODY)} AS content FROM part) code_raw"""

# Harder shapes: nested and conditional functions, several targets, text that looks like code
# inside strings, relative and bracketed imports, class chains, syntax errors, components,
# includes, files at the project root.
_RICH_BODY = """CASE p_partkey % 8
      WHEN 0 THEN 'import os.path as p, sys~from . import core{j}~from .shapes import (~    Shape{j} as S,~    area,~)~~first = second = {n}~count: int = 3~count += 1~~class Shape{k}(Shape{j}, Shape{m}, abc.ABC):~    limit = 5~    def area(self, a, b, c, d, e):~        return a~    if limit:~        def grow(self):~            return 1~    async def later(self):~        pass~    def name(self):~        def inner(x, y):~            return x~        return inner~'
      WHEN 1 THEN '~\"\"\"Notes on {nm}~def fake(a): pass~class Fake: pass~import nothing~\"\"\"~class Tool{m}:~    def run(self): pass~~def outer{k}(first, *rest, key=None, **more):~    for item in rest:~        if item:~            def deep(z): return z~    return first~~total{k} = outer{k}(~    1,~    2)~'
      WHEN 2 THEN 'import React, { Component } from ^react^;~import ^./style{j}.css^;~const List{k} = (props) => {~  return null;~};~export default class Panel{m} extends Component {~}~var helper{k} = function(a) { return a; };~const api = { load{k}: function(x) { return x; } };~'
      WHEN 3 THEN '#include <mod{j}.h>~using std{m};~struct Node{k} {~  int id;~};~// {nm}~* star line~fn walk{k}~size = 4~size == 4~procedure step{m}()~'
      WHEN 4 THEN 'def broken(:~    pass~import os~class Half{k}~x = 1~'
      WHEN 5 THEN '<html><body>{nm}<p>import everything</p></body></html>~'
      WHEN 6 THEN 'package org.team{m}.core;~import java.util.Map;~public final class Node{k} extends Node{j} {~  private static <T> Map<T> copyAll(Map<T> in) { return new Copy(in); }~  if (a) { catch (e) { } }~}~class Small{k} implements One,Two {}~'
      ELSE 'import test_tools{j}~from mod{j} import Base{j}~from mod{j} import unit{m}~# why {nm}~# second line about Circle{k}~class Circle{k}(Shape{m}, Tool{m}):~    def area(self):~        return {n}~    def draw(self, pen):~        while pen:~            pen = None~~# top note~def should_fit{k}(box):~    try:~        return box~    except ValueError:~        return None~' END"""

_RICH_PATH = """concat(
         CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'src/' WHEN 2 THEN 'src/core/'
              WHEN 3 THEN concat('lib/mod', CAST(p_partkey % 7 AS VARCHAR(9)), '/') ELSE 'src/ui/' END,
         CASE WHEN p_partkey % 13 = 0 THEN 'mod' WHEN p_partkey % 3 = 0 THEN 'Shape' ELSE 'node' END,
         CAST(p_partkey AS VARCHAR(9)),
         CASE p_partkey % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.py' WHEN 2 THEN '.js' WHEN 3 THEN '.h'
              WHEN 4 THEN '.py' WHEN 5 THEN '.html' WHEN 6 THEN '.java' ELSE '.py' END)"""

RICH_FILES = f"""SELECT concat('team', CAST(p_partkey % 3 AS VARCHAR(9))) AS project,
  {_RICH_PATH} AS path, {_FILL.format(body=_RICH_BODY)} AS content FROM part"""

FILES = f"{CODE_FILES} UNION ALL {RICH_FILES}"

# All projects and a fork of each of the harder ones, which has moved on here and there.
FORKED_FILES = f"""{FILES} UNION ALL SELECT concat(project, '-fork') AS project, path,
  replace(replace(replace(content, 'return a', 'if a: return a + 1'), 'def name(self)', 'def title(self)'),
    'for item in rest', 'while rest') AS content FROM ({RICH_FILES}) forked"""

# The files as they are a day later: some have grown a line, some are gone.
_UNIT = "CAST(split_part(split_part(path, 'unit', 2), '.', 1) AS INT)"
LATER_FILES = f"""SELECT project, path, CASE WHEN {_UNIT} % 10 = 0 THEN concat(content, '# more', chr(10)) ELSE content END AS content
FROM ({CODE_FILES}) before WHERE {_UNIT} % 17 <> 1"""

# Uploads of assorted type and size per source.
UPLOADS = """SELECT source AS project, doc_id AS ord, CAST(n_chars * 900 AS BIGINT) AS size,
  concat('file', CAST(doc_id AS VARCHAR(12)), CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.JS'
    WHEN 2 THEN '.txt' WHEN 3 THEN '' WHEN 4 THEN '.tar.rb' ELSE '.go' END) AS name
FROM documents"""

# Paths asked for: exact, shortened, lengthened and unknown.
PATH_REQUESTS = """SELECT DISTINCT concat('mod', CAST(p_partkey % 7 AS VARCHAR(9))) AS project,
  CASE p_partkey % 5
    WHEN 0 THEN concat('mod', CAST(p_partkey % 7 AS VARCHAR(9)), '/unit', CAST(p_partkey AS VARCHAR(9)), '.py')
    WHEN 1 THEN concat('unit', CAST(p_partkey AS VARCHAR(9)), '.js')
    WHEN 2 THEN concat('/srv/mod', CAST(p_partkey % 7 AS VARCHAR(9)), '/unit', CAST(p_partkey AS VARCHAR(9)), '.java')
    WHEN 3 THEN concat(CAST(p_partkey % 50 AS VARCHAR(9)), '.go')
    ELSE concat('missing', CAST(p_partkey AS VARCHAR(9)), '.c') END AS request
FROM part"""

# Lines asked for: a file name and a line number.
LINE_REQUESTS = """SELECT CAST(p_partkey AS BIGINT) AS qid,
  concat('mod', CAST(p_partkey % 7 AS VARCHAR(9))) AS project,
  concat('unit', CAST(p_partkey AS VARCHAR(9)), CASE p_partkey % 9 WHEN 8 THEN '.zip' ELSE '.' END) AS file_name,
  CAST(p_partkey % 15 AS INT) AS line
FROM part"""

# All projects, two of them without any file.
PROJECTS = "SELECT DISTINCT concat('mod', CAST(p_partkey % 9 AS VARCHAR(9))) AS project FROM part"

# Insights stored for some files, and the parts a reviewer replaces.
STORED = """SELECT DISTINCT concat('mod', CAST(p_partkey % 7 AS VARCHAR(9))) AS project,
  concat('mod', CAST(p_partkey % 7 AS VARCHAR(9)), '/unit', CAST(p_partkey AS VARCHAR(9)), '.go') AS path,
  CAST(p_size AS INT) AS quality_score
FROM part"""

# One question per part about one of the seven code projects.
QUESTIONS = """SELECT CAST(p_partkey AS BIGINT) AS qid,
  concat('mod', CAST(p_partkey % 7 AS VARCHAR(9))) AS project,
  replace(replace(replace(CASE p_partkey % 19
    WHEN 0 THEN 'What does helper{k} do?'
    WHEN 1 THEN 'how does load_item{n} work?'
    WHEN 2 THEN 'Where is helper{k} used?'
    WHEN 3 THEN 'where is view{j} defined?'
    WHEN 4 THEN 'Why does view{n} '
    WHEN 5 THEN 'list all functions'
    WHEN 6 THEN 'list all classes?'
    WHEN 7 THEN 'list all files'
    WHEN 8 THEN 'please list all imports'
    WHEN 9 THEN 'explain secret'
    WHEN 10 THEN 'compare item{j} with view{n}'
    WHEN 11 THEN 'hello there'
    WHEN 12 THEN 'what is unit{k}?'
    WHEN 13 THEN 'what is {n}00?'
    WHEN 14 THEN 'where is hashlib used?'
    WHEN 15 THEN 'compare helper{n} and load_item1'
    WHEN 16 THEN 'compare unit{n} to unit1{n}'
    WHEN 17 THEN 'explain query'
    ELSE 'why is item{n}?' END,
    '{k}', CAST(p_partkey AS VARCHAR(9))), '{j}', CAST((p_partkey * 6) % 300 AS VARCHAR(9))),
    '{n}', CAST(p_size AS VARCHAR(9))) AS text
FROM part"""

# One repository address per customer: both spellings, with and without suffix, and bad ones.
REPO_URLS = """SELECT CASE c_custkey % 6
    WHEN 0 THEN concat('https://github.com/', lower(c_mktsegment), '/repo', CAST(c_custkey % 40 AS VARCHAR(9)))
    WHEN 1 THEN concat('https://github.com/', lower(c_mktsegment), '/repo', CAST(c_custkey % 40 AS VARCHAR(9)), '.git')
    WHEN 2 THEN concat('git@github.com:', lower(c_mktsegment), '/repo', CAST(c_custkey % 40 AS VARCHAR(9)), '.git')
    WHEN 3 THEN concat('https://example.org/', c_name)
    WHEN 4 THEN concat('https://github.com/', c_name)
    ELSE concat('git@github.com:team', CAST(c_nationkey AS VARCHAR(9)), '/tool.kit') END AS url
FROM customer"""
