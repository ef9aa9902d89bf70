import zipfile

from corpusframe import ship


def test_archive_holds_the_package(spark):
    with zipfile.ZipFile(ship.ship(spark)) as z:
        names = set(z.namelist())
    assert {"corpusframe/__init__.py", "corpusframe/functions/edit.py", "corpusframe/operators/segments.py"} <= names
    assert spark.range(4).mapInArrow(lambda batches: (b for b in batches if __import__("corpusframe.functions.edit")), "id long").count() == 4
