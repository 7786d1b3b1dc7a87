"""Import every query module so that the registry is complete."""

from . import q_ingest  # noqa: F401
from . import q_profile  # noqa: F401
from . import q_audit  # noqa: F401
from . import q_metrics  # noqa: F401
from . import q_cluster  # noqa: F401
from . import q_models  # noqa: F401
from . import q_explain  # noqa: F401
from . import q_extra  # noqa: F401
from . import q_trained  # noqa: F401
from . import q_sparse  # noqa: F401
