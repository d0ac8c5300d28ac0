"""Document chunking, versioned chunk collections and vector retrieval on Spark."""

from pyspark import cloudpickle as _cloudpickle

from chunkloom.functions import packing as _packing
from chunkloom.functions import vectors as _vectors
from chunkloom.operators import embedding as _embedding
from chunkloom.operators import ivf as _ivf
from chunkloom.operators import knn as _knn
from chunkloom.sources import files as _files
from chunkloom.sources import pages as _pages
from chunkloom.streaming import buffer as _buffer

# Functions that run inside tasks travel by value, so executors need no installed copy.
for _module in (_packing, _vectors, _embedding, _ivf, _knn, _files, _pages, _buffer):
    _cloudpickle.register_pickle_by_value(_module)
