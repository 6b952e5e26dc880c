"""The sample file and the derived corpus against values worked out by hand."""

from pyspark.sql import functions as F

from codequarry import fixtures as FX
from codequarry.operators import links as L
from codequarry.operators import rollup as R
from codequarry.operators.analysis import analyse_files

SAMPLE = '''
import os
import sys
from datetime import datetime

# A simple class
class Person:
    def __init__(self, name, age):
        self.name = name
        self.age = age
    
    def greet(self):
        return f"Hello, my name is {self.name} and I am {self.age} years old."
    
    def is_adult(self):
        return self.age >= 18

# A simple function
def calculate_age(birth_year):
    current_year = datetime.now().year
    return current_year - birth_year

# Main code
if __name__ == "__main__":
    person = Person("John Doe", 30)
    print(person.greet())
    
    # Calculate age for different birth years
    years = [1990, 2000, 2010]
    for year in years:
        age = calculate_age(year)
        print(f"Someone born in {year} is {age} years old.")
'''


def test_sample_file(make_files):
    for mode in ("exact", "native"):
        analysed = analyse_files(make_files(("sample_code.py", SAMPLE)), mode)
        r = analysed.first()
        assert (r.line_count, r.comment_count, r.comment_ratio) == (32, 4, 0.12)
        assert [(e.type, e.name, e.line) for e in r.elements] == [
            ("import", "os", 2), ("import", "sys", 3),
            ("import", "from datetime import datetime", 4), ("class", "Person", 7),
            ("function", "calculate_age", 19)]
        assert r.elements[3].methods == ["__init__", "greet", "is_adult"]
        assert (r.complexity.cyclomatic, r.complexity.rating, r.complexity.max_nested_depth) == (
            3, "low", 2)
        assert [(s.type, s.line) for s in r.code_smells] == [("magic_number", 29)] * 3
        assert r.security_issues == [] and not r.short_names and r.quality_score == 85
        assert r.summary == ("Python file containing 3 imports, 1 classes, 1 functions with 32 "
                             "lines with some documentation (12% comments)")
        text = R.project_summary(analysed).first().text
        assert text == ("Project with 1 files (32 lines of code) primarily written in Python (1). "
                        "Contains 1 classes and 1 functions. This is a small project with "
                        "relatively simple structure.")


def test_derived_corpus_counts(spark):
    spark.read.parquet("/root/testdata/sf0.01/part.parquet").createOrReplaceTempView("part")
    files = spark.sql(FX.CODE_FILES).repartition(8)
    analysed = analyse_files(files).drop("content").persist()
    kinds = {(r.kind, r.type): r.cnt for r in R.finding_counts(analysed).groupBy("kind", "type").agg(
        F.sum("cnt").alias("cnt")).collect()}
    assert kinds == {
        ("smell", "long_method"): 333, ("smell", "complex_condition"): 334,
        ("smell", "magic_number"): 1714, ("smell", "too_many_arguments"): 334,
        ("security", "sql_injection"): 333, ("security", "command_injection"): 333,
        ("security", "hardcoded_secret"): 334, ("security", "insecure_hash"): 667}
    sums = analysed.agg(F.sum("comment_count"), F.count_if("short_names"), F.count("*")).first()
    assert tuple(sums) == (1667, 333, 2000)
    one_project = analysed.withColumn("project", F.lit("all"))
    assert L.file_edges(one_project).where("src <> dst").count() == 586
    analysed.unpersist()
