"""Import every query module so their ``@register`` calls run."""

from . import q_enrich  # noqa: F401
from . import q_features  # noqa: F401
from . import q_rollups  # noqa: F401
from . import q_clean  # noqa: F401
from . import q_classic  # noqa: F401
from . import q_ml  # noqa: F401
from . import q_io  # noqa: F401
from . import q_extra  # noqa: F401
from . import q_landed  # noqa: F401
from . import q_batches  # noqa: F401
