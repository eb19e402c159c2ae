"""tesserae: a Spark-native engine for distillation corpora.

Builds, samples, splits, renders, batch-infers, resumes, scores, compares and
audits prompt/response corpora as DataFrame plans.  Scalar work lives in
``tesserae.functions`` (Column -> Column), relational work in
``tesserae.operators`` (DataFrame -> DataFrame), file I/O in
``tesserae.sources``, the incremental job in ``tesserae.streaming`` and the
queries over the driver tables in ``tesserae.plans``.
"""

from tesserae.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
