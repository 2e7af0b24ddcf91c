from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from faultline.operators.estimators import StackedClassifier, StackedModel
from faultline.sources import readers

X = [f"x{k}" for k in range(3)]


def test_parameters_copies_and_files(spark, tmp_path):
    df = readers.synthetic_projects(spark, {"ant": 80, "camel": 60}, 3, separable=True)
    df = df.select(F.xxhash64("project", "row_id").alias("row_id"), *X, "y")
    asked = StackedClassifier(inputCols=X, folds=2, trees=4, rounds=2)
    assert asked.copy({asked.trees: 3}).getOrDefault("trees") == 3 and asked.getOrDefault("trees") == 4
    asked.save(f"file://{tmp_path}/estimator")
    again = StackedClassifier.load(f"file://{tmp_path}/estimator")
    assert again.getInputCols() == X and again.getOrDefault("rounds") == 2 and again.getOrDefault("mlp") is False
    model = Pipeline(stages=[SQLTransformer(statement="SELECT * FROM __THIS__ WHERE row_id IS NOT NULL"), again]).fit(df).stages[-1]
    assert isinstance(model, StackedModel)
    model.save(f"file://{tmp_path}/model")
    rows = [sorted(map(tuple, m.transform(df.drop("y")).select("row_id", "score", "pred").collect())) for m in (model, StackedModel.load(f"file://{tmp_path}/model"))]
    assert rows[0] == rows[1] and len(rows[0]) == 140
