import pytest

from ledgerloom.operators.features import DEMAND, training_set
from ledgerloom.plans.registry import ModelRegistry, train_and_publish
from ledgerloom.plans.training import fit_model
from ledgerloom.session import materialise, scratch_path


@pytest.fixture(scope="module")
def cells(sales):
    return materialise(training_set(sales, DEMAND))


def test_the_pointer_names_one_version(spark, cells):
    registry = ModelRegistry(spark, scratch_path(spark, "registry"))
    with pytest.raises(LookupError):
        registry.current("demand")
    first = registry.publish(fit_model(cells, DEMAND, "ridge"))
    assert registry.current("demand") == first and registry.load("demand").name == "ridge"
    assert registry.load("demand") is registry.load("demand")  # read once a version
    second = registry.publish(fit_model(cells, DEMAND, "lasso"))
    reader = ModelRegistry(spark, registry.root)
    assert reader.load("demand").version == second and registry.load("demand").name == "lasso"
    registry.rollback("demand", first)
    assert reader.load("demand").name == "ridge"
    with pytest.raises(LookupError):
        registry.rollback("demand", "none")
    third = registry.publish(fit_model(cells, DEMAND, "linear"))
    registry.rollback("demand", first)
    assert registry.prune("demand", keep=1) == [second] and registry.versions("demand") == [first, third]


def test_a_failed_save_leaves_the_served_version(spark, cells, monkeypatch):
    registry = ModelRegistry(spark, scratch_path(spark, "registry"))
    model = fit_model(cells, DEMAND, "ridge")
    version = registry.publish(model)

    def fails(path):
        raise OSError("disk full")

    monkeypatch.setattr(model, "save", fails)
    with pytest.raises(OSError):
        registry.publish(model)
    assert registry.current("demand") == version


def test_the_published_model_is_the_compared_winner(spark, cells):
    registry = ModelRegistry(spark, scratch_path(spark, "registry"))
    version, model = train_and_publish(cells, DEMAND, registry, ("linear", "lasso"))
    table = registry.comparison("demand").orderBy("place").collect()
    assert len(table) == 2 and table[0].model == model.name and registry.load("demand").version == version
    known = model.predict(cells).select("row_key", "prediction")
    assert known.exceptAll(registry.load("demand").predict(cells).select("row_key", "prediction")).count() == 0
