import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from annospark.session import local_session  # noqa: E402

BOXES = "image_id string, box_ord long, x1 double, y1 double, x2 double, y2 double, label int, p_good double, det_conf double"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", app="annospark-tests")
    yield session
    session.stop()


@pytest.fixture
def make_boxes(spark):
    def build(rows, image="img"):
        """Rows are ``(x1, y1, x2, y2[, p_good[, label[, image]]])`` in list order."""
        full = []
        for i, r in enumerate(rows):
            good = float(r[4]) if len(r) > 4 else 0.9
            label = r[5] if len(r) > 5 else 0
            full.append((r[6] if len(r) > 6 else image, i, *map(float, r[:4]), label, good, good))
        return spark.createDataFrame(full, BOXES)

    return build
